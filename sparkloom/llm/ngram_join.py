"""N-gram Jaccard self-join of documents by prefixes under several global token orders.

A document is the set of its distinct `width`-word shingles, as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. If they do, then under any order of all tokens the first
n - ceil(percent * n / 100) + 1 tokens of both, their prefixes, have a token in common.

1. One scan gives each document's size and set signature, its prefixes under two orders by hash, and a sketch of
   2**SKETCH counts: how often tokens occur, a fixed size for any corpus. Documents with one signature are one class; classes are joined, not documents.
2. The main order puts tokens of rare counts first (ties by hash). Classes are posted under the tokens of
   their prefix. A pair can link only if, at its first common token, enough tokens of both are left (position filter).
3. In each posting list the class with the earliest position is the leader; all others are candidates with it. That
   joins groups of near copies without their pairs. Then only lists that still hold several components are searched, for pairs
   of different components; a long list is dealt into blocks, and each pair of blocks is a group of its own. Every link between
   components is found, so the components are those of all links.
4. A candidate pair goes on only if its prefixes also meet under each of the other orders. These filters are joins on small arrays, so
   they are intersected before any set is fetched. Then the texts of both representatives meet, which are a good deal smaller than their sets,
   and the whole sets are made of them and compared.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered; with fewer than `width` words the whole sequence is one
shingle; without any (null texts too) the set is empty and links with nothing. Rows that repeat an id are
rows of their own with that id. Rows without an id are given back with their size and no component. A text is one
set in the memory of a task, however long. An empty table gives no rows. Other columns of the documents are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .components import components
from .kernel import cut_rows, mix64, shingle_sets, string_bytes
from .store import free_name, settle

SKETCH, PIECES = 22, 256
BLOCK = 512  # postings of a token that one group compares with one another
SEEN = 1 << 17  # signatures that a task remembers, so as not to post equal sets again: a matter of speed only
# The seeds that make the other token orders.
ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signature(tokens: np.ndarray) -> int:
    return int(mix64(tokens + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64)) if len(tokens) else 0


def _other_prefix(tokens: np.ndarray, seed: np.uint64, percent: int) -> np.ndarray:
    """The prefix of a set under the order of one seed, 16 bits a token: prefixes that meet still do when cut."""
    if not len(tokens):
        return np.zeros(0, np.int16)
    order, p = mix64(tokens ^ seed), prefix_length(len(tokens), percent)
    return (order if p >= len(order) else np.partition(order, p - 1)[:p]).astype(np.uint16).view(np.int16)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _scan(width: int, percent: int):
    """doc_id, text -> rows of documents (doc_id, n, s, first, second) and, at a partition's end, pieces of its sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "s", "first", "second", "piece", "counts"]
        sketch = np.zeros(1 << SKETCH, np.uint32)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part, data, offsets in cut_rows(batch, "text"):
                sets = shingle_sets(data, offsets, width)
                low = (np.concatenate(sets) & np.uint64((1 << SKETCH) - 1)).astype(np.int64)
                np.add.at(sketch, low, np.uint32(1))
                k = part.num_rows
                lists = [_lists([_other_prefix(x, seed, percent) for x in sets], pa.int16()) for seed in ORDERS]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_signature(x) for x in sets], pa.int64()), *lists, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if kind is not None:
            pieces = sketch.reshape(PIECES, -1)
            for k in np.flatnonzero(pieces.any(axis=1)).tolist():
                blob = zlib.compress(pieces[k].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.list_(pa.int16()))] * 2, pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=names)

    return rows


def _sketch(scanned: DataFrame) -> np.ndarray:
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.zeros((1 << SKETCH) // PIECES, np.uint32)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
            piece = batch.column("piece")[0].as_py() if batch.num_rows else piece
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "counts"])

    out = np.zeros((PIECES, (1 << SKETCH) // PIECES), np.uint32)
    pieces = scanned.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(merged, "piece int, counts binary")
    for r in pieces.collect():  # 4 * 2**SKETCH bytes in all
        out[r["piece"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _ranks(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The first order: by count, then by hash."""
    counts = np.minimum(sketch[(tokens & np.uint64((1 << SKETCH) - 1)).astype(np.int64)], np.uint32((1 << 24) - 1)).astype(np.uint64)
    return counts << np.uint64(40) | mix64(tokens) >> np.uint64(24)


def _post(width: int, percent: int, shared):
    """text -> token, s, n, at: the prefix of each set under the first order; one of equal sets in a partition is enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in cut_rows(batch, "text"):
                out: list[np.ndarray] = []
                about: list[tuple[int, int, int]] = []
                for tokens in shingle_sets(data, offsets, width):
                    n, s = len(tokens), _signature(tokens)
                    if n and s not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(s)
                        p = prefix_length(n, percent)
                        out.append(tokens[np.argsort(_ranks(tokens, sketch))[:p]])
                        about.append((s, n, p))
                if out:
                    sizes = np.array([p for _, _, p in about])
                    flat = np.concatenate(out).view(np.int64)
                    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    s, n = np.repeat(np.array([a[0] for a in about], np.int64), sizes), np.repeat(np.array([a[1] for a in about], np.int64), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(s), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names=["token", "s", "n", "at"])

    return rows


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()


def _may_link(n: Column, at: Column, m: Column, bt: Column, percent: int) -> Column:
    """Length and position filters."""
    left = F.least(n - at, m - bt).cast("long")
    return (100 * left >= percent * (n + m - left)) & (100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m).cast("long"))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets link."""
    x, y = len(a), len(b)
    if 100 * min(x, y) < percent * max(x, y):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (x + y - both)


class Join:
    """The steps share the documents' scan; `documents` has doc_id and text."""

    def __init__(self, documents: DataFrame, width: int, percent: int):
        self.percent, self.width = percent, width
        self.documents = documents.select("doc_id", "text")
        kind = documents.schema["doc_id"].dataType.simpleString()
        self.spark = documents.sparkSession
        scanned = settle(self.documents.mapInArrow(_scan(width, percent), f"doc_id {kind}, n long, s long, first array<smallint>, second array<smallint>, piece int, counts binary"), "shingle-scan")
        self.rows = scanned.where("piece IS NULL").select("doc_id", "n", "s")
        self.sketch = self.spark.sparkContext.broadcast(_sketch(scanned))
        self.known = scanned.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = settle(self.known.groupBy("s", "n").agg(F.min("doc_id").alias("rep")), "shingle-classes")

    def postings(self) -> DataFrame:
        """token, s, n, at of tokens that several classes are posted under."""
        rows = settle(self.documents.where("doc_id IS NOT NULL").select("text").mapInArrow(_post(self.width, self.percent, self.sketch), "token long, s long, n int, at int"), "postings")
        self.sketch.destroy()
        several = rows.groupBy("token").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a < b").select("token")
        several = settle(several, "shared-tokens")
        near = bits.table(several, "token").keep(rows, "token")
        return settle(near.join(several, "token", "left_semi").distinct(), "shared-postings")

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes meet under the other orders too. Rows of equal sets repeat here, and are alike; bits leave out sets that are in no pair."""
        asked = settle(_ends(pairs), "asked-classes")
        near = bits.table(asked, "s").keep(self.known.select("s", "first", "second"), "s")
        near = settle(near.dropDuplicates(["s"]), "class-orders")
        left, right = (near.select(F.col("s").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("first", "second")]) for c in "ab")
        meet = F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("second_a", "second_b")
        return settle(pairs.join(left, "a").join(right, "b").where(meet).select("a", "b"), "plausible-pairs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs: a, b (signatures; b those that stand in many pairs). Those that link, on the whole texts of their representatives; bits of these ids drop the other texts where they are scanned."""
        width, percent = self.width, self.percent
        pairs = self._plausible(pairs)
        named = self.classes.join(_ends(pairs), "s").select("s", "rep")
        left, right = (named.select(F.col("s").alias(c), F.col("rep").alias("rep_" + c)) for c in "ab")
        pairs = settle(pairs.join(left, "a").join(right, "b"), "named-pairs")
        reps = settle(pairs.select(F.col("rep_a").alias("doc_id")).unionByName(pairs.select(F.col("rep_b").alias("doc_id"))).distinct(), "shingle-reps")
        texts = bits.table(reps, "doc_id").keep(self.documents, "doc_id")

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in cut_rows(batch, "text_b"):
                    a, b = (part.column(c).to_pylist() for c in ("a", "b"))
                    mine, other = shingle_sets(*string_bytes(part.column("text_a")), width), shingle_sets(data, offsets, width)
                    # Where an id is repeated, only its text with the signature asked for counts.
                    good = [_signature(x) == s and _signature(y) == t and jaccard_at_least(x, y, percent) for x, y, s, t in zip(mine, other, a, b, strict=True)]
                    got = part.filter(pa.array(good, pa.bool_()))
                    yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b")], names=["a", "b"])

        own, met = (texts.select(F.col("doc_id").alias("rep_" + c), F.col("text").alias("text_" + c)) for c in "ab")
        return pairs.join(own, "rep_a").join(met, "rep_b").select("a", "b", "text_a", "text_b").mapInArrow(linked, "a long, b long").distinct()

    def components(self) -> DataFrame:
        """node, root: signatures of sets that link, and one signature for each component."""
        percent = self.percent
        posted = self.postings()
        early = F.struct((F.col("at") / F.col("n")).alias("r"), "s", "n", "at")
        leaders = posted.groupBy("token").agg(F.min(early).alias("l"))
        stars = posted.join(leaders, "token").where((F.col("s") != F.col("l.s")) & _may_link(F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at"), percent))
        stars = settle(stars.select(F.col("s").alias("a"), F.col("l.s").alias("b")).distinct(), "star-pairs")
        joined = components(settle(self.verified(stars), "star-links"))

        named = posted.join(joined.select(F.col("node").alias("s"), "root"), "s", "left")
        named = named.select("token", "s", "n", "at", F.coalesce("root", "s").alias("part"))
        open_ = named.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("x < y").select("token", "blocks")
        live = settle(named.join(open_, "token"), "open-postings")
        # A posting stands in its own block, and meets every block of its list: groups are pairs of blocks, low and high.
        live = live.withColumn("own", F.pmod(F.xxhash64("s"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        live = live.select("token", "s", "n", "at", "part", "own", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"))
        left, right = live.where("own = low"), live.where("own = high").select("token", "low", "high", *[F.col(c).alias(c + "_") for c in ("s", "n", "at", "part")])
        meet = ((F.col("low") < F.col("high")) | (F.col("s") < F.col("s_"))) & (F.col("part") != F.col("part_")) & _may_link(F.col("n"), F.col("at"), F.col("n_"), F.col("at_"), percent)
        pairs = left.join(right, ["token", "low", "high"]).where(meet).select(F.least("s", "s_").alias("a"), F.greatest("s", "s_").alias("b")).distinct()
        tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = settle(pairs.join(tried, ["a", "b"], "left_anti"), "cross-pairs")
        if pairs.isEmpty():
            return joined
        more = settle(self.verified(pairs), "cross-links")
        if more.isEmpty():
            return joined
        return components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def link(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    join = Join(documents, width, percent)
    roots = join.components().select(F.col("node").alias("s"), F.col("root").alias("part"))
    rooted = settle(join.classes.join(roots, "s", "left").select("s", "n", "rep", F.coalesce("part", "s").alias("part")), "rooted-classes")
    least = rooted.groupBy("part").agg(F.min("rep").alias("least"))
    of_class = rooted.join(least, "part").select(F.col("s").alias("c_s"), F.col("n").alias("c_n"), F.col("least").alias("part"))
    out = join.rows.join(of_class, (F.col("s") == F.col("c_s")) & (F.col("n") == F.col("c_n")) & (F.col("n") > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those that link, over any number of links, to one of a smaller id.

    Rows without an id stay; of rows that repeat an id one stays. Only rows that the bits of the ids to drop let
    through are shuffled.
    """
    linked = settle(link(documents, width, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("part")), "near-copies")
    odd = settle(linked.where("part <> doc_id OR rows > 1"), "odd-copies")
    mark = free_name(documents)
    marked = bits.table(odd, "doc_id").flag(documents, "doc_id", mark)
    plain = marked.where(~F.col(mark)).drop(mark)
    gone, twice = odd.where("part <> doc_id").select("doc_id"), odd.where("part = doc_id AND rows > 1").select("doc_id")
    asked = marked.where(F.col(mark)).drop(mark).join(gone, "doc_id", "left_anti")
    single = asked.join(twice, "doc_id", "left_anti")
    repeated = asked.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return plain.unionByName(single).unionByName(repeated).select(*documents.columns)
