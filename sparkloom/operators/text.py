"""Suffix arrays, common prefixes and words of strings, for a table of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.tables import dealt, settle


def characters(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), c: the unsigned bytes of each text."""
    bytes_ = F.hex(F.encode(text, "UTF-8"))
    at = F.explode(F.sequence(F.lit(0), (F.length(bytes_) / 2).cast("int") - 1)).alias("pos")
    rows = df.where(F.length(text) > 0).select(key, bytes_.alias("__h"), at)
    return rows.select(key, F.col("pos").cast("long"), F.conv(F.substring("__h", (F.col("pos") * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long").alias("c"))


def _suffixes_by_rounds(chars: DataFrame, key: str, whole: bool) -> DataFrame:
    """Suffixes are named by their first 2^k bytes, then by pairs of names, until all names differ. Names are dense ranks within
    each text; with `whole` there is one text that may be of any size, and names come from a range-partitioned sort.
    """
    names = settle(chars.select(key, "pos", F.col("c").alias("name")), "suffix-names")
    length = 1
    while True:
        other = names.select(key, (F.col("pos") - length).alias("pos"), F.col("name").alias("next"))
        pairs = names.join(other, [key, "pos"], "left").fillna(-1, ["next"])
        if whole:
            told = blocks.dense_index(pairs.select("name", "next").distinct(), "name", "next", name="new")
            named = pairs.join(told, ["name", "next"])
        else:
            named = pairs.withColumn("new", (F.dense_rank().over(Window.partitionBy(key).orderBy("name", "next")) - 1).cast("long"))
        names = settle(named.select(key, "pos", F.col("new").alias("name")), "suffix-names")
        length *= 2
        open_ = names.groupBy(key, "name").agg(F.count("*").alias("n")).where("n > 1")
        if open_.isEmpty():
            return names.select(key, F.col("name").alias("rank"), "pos")


def _prefixes_by_rounds(chars: DataFrame, suffixes: DataFrame, key: str) -> DataFrame:
    """Both suffixes are advanced by halving powers of two, with names of all blocks of that length.
    """
    names = [settle(chars.select(key, "pos", F.col("c").alias("name")), "block-names")]
    ends = chars.groupBy(key).agg(F.max("pos").alias("last"))
    most = ends.agg(F.max("last").alias("m")).first()["m"] or 0
    while 2 ** len(names) <= most + 1:
        step = 2 ** (len(names) - 1)
        below = names[-1]
        pair = below.join(below.select(key, (F.col("pos") - step).alias("pos"), F.col("name").alias("next")), [key, "pos"])
        names.append(settle(pair.select(key, "pos", F.dense_rank().over(Window.partitionBy(key).orderBy("name", "next")).cast("long").alias("name")), "block-names"))
    following = suffixes.select(key, (F.col("rank") - 1).alias("rank"), F.col("pos").alias("b"))
    pairs = suffixes.join(following, [key, "rank"], "left").withColumn("a", F.col("pos")).withColumn("lcp", F.when(F.col("b").isNotNull(), F.lit(0).cast("long")))
    for k in reversed(range(len(names))):
        step = 2**k
        left = names[k].select(key, F.col("pos").alias("a"), F.col("name").alias("na"))
        right = names[k].select(key, F.col("pos").alias("b"), F.col("name").alias("nb"))
        pairs = pairs.join(left, [key, "a"], "left").join(right, [key, "b"], "left")
        same = F.coalesce(F.col("na") == F.col("nb"), F.lit(False))
        pairs = pairs.select(key, "rank", "pos", *[(F.when(same, F.col(c) + step).otherwise(F.col(c))).alias(c) for c in ("a", "b", "lcp")])
    return pairs.select(key, "rank", "pos", "lcp")


#: Bytes of the longest texts that are ordered whole in one task, and of the texts that a worker orders at once.
TOGETHER = 1 << 18


def _doubled(names: np.ndarray, at: np.ndarray, left: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """names of the blocks of 1, 2, 4, ... up to `most` bytes that begin at each place, in order of texts, then of bytes; a block ends with its text.

    names: of single bytes; left: bytes from each place to the end of its text.
    """
    yield names
    step = 1
    while step <= most:
        inside = np.flatnonzero(left > step)
        further = np.zeros(len(names), np.int64)
        further[inside] = names[at[inside] + step] + 1
        names = np.unique(names * (len(names) + 1) + further, return_inverse=True)[1].reshape(-1)
        step *= 2
        yield names


def _ordered(key: str, ranked: bool):
    """Whole texts of rows key, pos, c, rank in order of (key, pos): key, rank, pos, or, where ranks are given, key, rank, pos, lcp."""

    def told(texts: pa.Table) -> pa.RecordBatch:
        code = texts.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        pos, c, rank = (texts.column(k).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        real = c >= 0  # the other rows have ranks
        group = np.cumsum(np.append(False, code[1:] != code[:-1]))
        g, n = group[real], int(real.sum())
        at, first = np.arange(n), np.searchsorted(g, np.unique(g))
        size = np.diff(np.append(first, n))
        start, size = first[np.searchsorted(g[first], g)], size[np.searchsorted(g[first], g)]
        left = size - (at - start)
        levels = list(_doubled(np.unique(g * 256 + c[real], return_inverse=True)[1].reshape(-1), at, left, int(size.max(initial=0))))
        keys = texts.column(0).combine_chunks()
        if not ranked:
            return pa.RecordBatch.from_arrays([keys.filter(pa.array(real)), pa.array(levels[-1] - start), pa.array(pos[real])], names=[key, "rank", "pos"])
        begin = np.zeros(int(group.max(initial=0)) + 1, np.int64)
        begin[g[first]] = first
        given = np.flatnonzero(~real)
        own, place = begin[group[given]] + pos[given], begin[group[given]] + rank[given]
        following = np.full(n + 1, -1)
        following[place] = own
        b = np.where(rank[given] + 1 < size[own], following[np.minimum(place + 1, n)], -1)
        has, lcp = np.flatnonzero(b >= 0), np.zeros(len(given), np.int64)
        one, two, ends = own[has], b[has], (start + size)[own[has]]
        for k in reversed(range(len(levels))):
            open_ = np.flatnonzero((one < ends) & (two < ends))
            same = open_[levels[k][one[open_]] == levels[k][two[open_]]]
            one[same] += 1 << k
            two[same] += 1 << k
        lcp[has] = one - own[has]
        return pa.RecordBatch.from_arrays([keys.filter(pa.array(~real)), pa.array(rank[given]), pa.array(pos[given]), pa.array(lcp, mask=b < 0)], names=[key, "rank", "pos", "lcp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= TOGETHER:
                code = held.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0  # the last text may go on
                if cut:
                    yield told(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield told(held)

    return run


def _by_length(chars: DataFrame, key: str) -> tuple[int, DataFrame | None]:
    """Bytes of all texts, and the keys of those longer than TOGETHER, if any."""
    sizes = chars.groupBy(key).agg(F.count("*").alias("n"))
    told = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    return told["n"] or 0, sizes.where(F.col("n") > TOGETHER).select(key) if (told["most"] or 0) > TOGETHER else None


def suffix_array(chars: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """key, rank (from 0), pos: suffixes of each text in byte order, a shorter prefix first.

    Texts of up to TOGETHER bytes are dealt by key and ordered whole, many at once; longer ones, and with `whole` the one text there is, by rounds of joins.
    """
    if whole:
        return _suffixes_by_rounds(chars, key, whole)
    n, long = _by_length(chars, key)
    short = chars if long is None else chars.join(long, key, "left_anti")
    rows = dealt(short.select(key, "pos", "c", F.lit(None).cast("long").alias("rank")), n, key).sortWithinPartitions(key, "pos")
    found = rows.mapInArrow(_ordered(key, False), f"{key} {chars.schema[key].dataType.simpleString()}, rank long, pos long")
    return found if long is None else found.unionByName(_suffixes_by_rounds(chars.join(long, key, "left_semi"), key, False))


def common_prefixes(chars: DataFrame, suffixes: DataFrame, key: str) -> DataFrame:
    """suffixes with lcp: bytes that the suffix shares with the next one in order; null for the last. Texts are taken as in suffix_array."""
    n, long = _by_length(chars, key)
    pick = lambda df, how: df if long is None else df.join(long, key, how)
    both = pick(chars, "left_anti").select(key, "pos", "c", F.lit(None).cast("long").alias("rank"))
    both = both.unionByName(pick(suffixes, "left_anti").select(key, "pos", F.lit(None).cast("long").alias("c"), "rank"))
    found = dealt(both, 2 * n, key).sortWithinPartitions(key, "pos").mapInArrow(_ordered(key, True), f"{key} {chars.schema[key].dataType.simpleString()}, rank long, pos long, lcp long")
    return found if long is None else found.unionByName(_prefixes_by_rounds(chars.join(long, key, "left_semi"), suffixes.join(long, key, "left_semi"), key))


def words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Words between white space (space, tab, line ends, NUL), with their place."""
    rows = df.select(*keep, F.posexplode(F.split(text, r"[ \t\r\n\x00]+")).alias("at", "word")).where("word <> ''")
    return rows


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, n. Texts are dealt by key before they are cut, so that no row of a word is shuffled."""
    size = df.agg(F.sum(F.length(text).cast("long")).alias("n")).first()["n"] or 0
    return words(dealt(df.select(key, text), size // 6, key), text, key).groupBy(key, "word").agg(F.count("*").alias("n"))


def to_text(value: Column, kind: str) -> Column:
    """Numbers as text: integers plainly, doubles with eleven decimals in exponent form."""
    return F.format_string("%.11e", value.cast("double")) if kind == "double" else value.cast("string")


def string_hash(text: Column) -> Column:
    """A 64-bit hash of a string's bytes."""
    return F.xxhash64(text)
