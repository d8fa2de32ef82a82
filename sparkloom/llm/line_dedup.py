"""Line dedup by a deletion-neighbourhood join over words.

A line is dropped if an earlier line, in the order of (doc_id, number of the
line), equals it or, where the shorter of both has at least `SHORTEST` words, is one
word edit away: one word put in, left out or replaced. Lines are compared by
their words `[^\\x20\\x09-\\x0D]+`; lines without a word are kept and compared with nothing.

1. One pass gives each line a key of 128 bits and the hashes of its halves. Lines that occur again are found by counts of keys.
2. An edit leaves the first or the last half of the shorter line whole, so only
   lines that share such a half with another line go on: a filter that loses nothing.
3. Those emit, for each place i that the shared halves leave open, the variant with word i left out, and the
   line itself cut at i, both keyed by hashes of what stands before and after. Lines with an equal key
   differ at that place alone, so all lines of a key are one edit apart: the earliest
   of them is found by a minimum, never by pairs.
4. Each line is verified, word by word, against the earliest line of one of its keys.

Where rows are looked for in a table that was just found, its bits go first (`bits.py`): a few MB at most, never a broadcast table; the exact
join sees only what they let through. So texts are read again, not shuffled.

DataFrame operations only. Null texts have no lines. Rows without an id take no part and come back without drops;
rows that repeat an id and text share every decision, and of two equal places none is the earlier. Empty texts have one line without a
word, which is kept. Lines of any length are compared whole. Without rows nothing is dropped; other columns keep their values, whatever their names.

One word of `SHORTEST` is a similarity of 0.8; in a shorter line one changed word would leave less, so shorter lines are near copies only if they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bits
from .store import free_name, settle

SHORTEST = 5
_SPACE = r"[\x20\x09-\x0D]+"
_SUM_BITS = 24  # hashes lose so many bits, that sums over 2**24 words stay in a long


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, h, line_no, words of every line; hashes of words stand for the line."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "h", "line_no", F.array_remove(F.split("raw", _SPACE), "").alias("words"))


def _keys() -> list[Column]:
    return [F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), F.col("words")).alias("k2")]


def _halves(words: Column, n: Column) -> Column:
    """Hashes of the first and the last h words, for h half of the words, and half of one word less: array of (half, h, last)."""
    h1, h2 = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def pair(h: Column) -> Column:
        first, last = F.xxhash64(F.lit("first"), h, F.slice(words, F.lit(1), h)), F.xxhash64(F.lit("last"), h, F.slice(words, n - h + 1, h))
        return F.array(*[F.struct(x.alias("half"), h.alias("h"), F.lit(is_last).alias("last")) for x, is_last in ((first, False), (last, True))])

    return F.when(n < SHORTEST, F.array().cast("array<struct<half:bigint,h:int,last:boolean>>")).when(h1 == h2, pair(h1)).otherwise(F.concat(pair(h1), pair(h2)))


#: Lines of at most so many words hash each variant whole; longer ones sum hashes of words. Lines of this length and one word more do both, so no two neighbours are parted.
WHOLE = 1024


def _open(n: Column) -> tuple[Column, Column]:
    """A place i is open if i >= the first or i <= the second: outside a shared first half, or outside a shared last one."""
    return F.coalesce("first_h", n + 1), F.coalesce(n - F.col("last_h"), F.lit(-1))


def _short_variants(lines: DataFrame) -> DataFrame:
    """k1, k2, doc_id, line_no, hashes (of words), n, first_h, last_h -> key, k1, k2, doc_id, line_no, for the places that the shared halves leave open.

    Plain projections between two explodes, so that all of it is compiled: a lambda would be interpreted for each place.
    """
    n, i = F.col("n"), F.col("i")
    low, high = _open(n)
    places = lines.where(n <= WHOLE + 1).select("k1", "k2", "doc_id", "line_no", "n", "hashes", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.lit(0), n)).alias("i")).where((i >= F.col("low")) | (i <= F.col("high")))

    def key(skip: int) -> Column:
        return F.xxhash64(n - skip, i, F.slice("hashes", F.lit(1), i), F.slice("hashes", i + 1 + skip, n))

    cut = places.select(key(0).alias("key"), "k1", "k2", "doc_id", "line_no")
    return cut.unionByName(places.where(i < n).select(key(1).alias("key"), "k1", "k2", "doc_id", "line_no"))


def _long_variants(lines: DataFrame) -> DataFrame:
    """As _short_variants, for lines of any length in linear time: what stands before and after a place is hashed by sums over its words."""
    words = lines.where(F.col("n") >= WHOLE).select("k1", "k2", "doc_id", "line_no", "n", *[c.alias(x) for c, x in zip(_open(F.col("n")), ("low", "high"), strict=True)], F.posexplode("words").alias("i", "word"))

    def salted(seed: int, place: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), place, "word"), _SUM_BITS)

    forward, backward = F.col("i"), F.col("n") - F.col("i")
    words = words.select("k1", "k2", "doc_id", "line_no", "n", "low", "high", "i", *[salted(s, p).alias(c) for c, s, p in (("f1", 1, forward), ("f2", 2, forward), ("b1", 3, backward), ("b2", 4, backward))])
    before = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("k1", "k2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("k1", "k2")
    none = F.lit(0).cast("long")
    sums = words.select(
        "k1", "k2", "doc_id", "line_no", "n", "low", "high", "i", "b1", "b2", F.coalesce(F.sum("f1").over(before), none).alias("p1"), F.coalesce(F.sum("f2").over(before), none).alias("p2"),
        (F.sum("b1").over(whole) - F.sum("b1").over(all_)).alias("s1"), (F.sum("b2").over(whole) - F.sum("b2").over(all_)).alias("s2"), "f1", "f2")
    # Word i left out; the line cut before word i; and, at the last word, the line cut behind it.
    left_out = F.xxhash64(F.lit("long"), F.col("n") - 1, "i", "p1", "p2", "s1", "s2")
    cut = F.xxhash64(F.lit("long"), "n", "i", "p1", "p2", F.col("s1") + F.col("b1"), F.col("s2") + F.col("b2"))
    behind = F.xxhash64(F.lit("long"), "n", F.col("i") + 1, F.col("p1") + F.col("f1"), F.col("p2") + F.col("f2"), none, none)
    here = lambda i: (i >= F.col("low")) | (i <= F.col("high"))
    last = (F.col("i") == F.col("n") - 1) & here(F.col("n"))
    keys = F.array_compact(F.array(F.when(here(F.col("i")), left_out), F.when(here(F.col("i")), cut), F.when(last, behind)))
    return sums.select(F.explode(keys).alias("key"), "k1", "k2", "doc_id", "line_no")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart."""
    n, m = F.size(a), F.size(b)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: ~e))
    longer, shorter = F.when(n > m, a).otherwise(b), F.when(n > m, b).otherwise(a)
    # Words that agree from the front, and from the back, must together cover the shorter line.
    padded = F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y))
    back = F.zip_with(F.reverse(longer), F.reverse(shorter), lambda x, y: x.eqNullSafe(y))
    at, rest = F.array_position(padded, F.lit(False)), F.array_position(back, F.lit(False))
    return F.when(n == m, same <= 1).when(F.abs(n - m) == 1, (at - 1) + (rest - 1) >= F.least(n, m)).otherwise(False)


def _near(documents: DataFrame, known: DataFrame) -> DataFrame:
    """k1, k2 of lines with an earlier line one edit away. known: k1, k2, halves of every line."""
    halves = known.select("k1", "k2", F.explode("halves").alias("x")).select("k1", "k2", "x.*")
    shared = settle(halves.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("half"), "shared-halves")
    # Joins that follow a table of bits are inner joins with distinct keys: a semi-join would be pushed below it.
    met = bits.table(shared, "half").keep(halves, "half").join(shared, "half")
    candidates = met.groupBy("k1", "k2").agg(F.min(F.when(~F.col("last"), F.col("h"))).alias("first_h"), F.min(F.when(F.col("last"), F.col("h"))).alias("last_h"))
    candidates = settle(candidates, "line-candidates")
    found = bits.table(candidates, "k1").keep(_lines(documents).select("doc_id", "line_no", "words", *_keys()), "k1").join(candidates, ["k1", "k2"])
    distinct = found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("words").alias("words"), F.first("first_h").alias("first_h"), F.first("last_h").alias("last_h"))
    distinct = settle(distinct.select("k1", "k2", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.size("words").alias("n"), "first_h", "last_h", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")), "candidate-lines")
    variants = _short_variants(distinct).unionByName(_long_variants(distinct.repartition("k1", "k2")))
    keys = settle(variants.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("key"), "shared-variants")
    met = settle(bits.table(keys, "key").keep(variants, "key").join(keys, "key"), "met-variants")
    firsts = met.groupBy("key").agg(F.min(F.struct("doc_id", "line_no", "k1", "k2")).alias("first"))
    later = met.join(firsts, "key").where(F.struct("first.doc_id", "first.line_no") < F.struct("doc_id", "line_no"))
    pairs = later.groupBy("k1", "k2").agg(F.min("first").alias("first")).select("k1", "k2", F.col("first.k1").alias("e1"), F.col("first.k2").alias("e2"))
    other = distinct.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("words").alias("other"))
    verified = pairs.join(distinct.select("k1", "k2", "words"), ["k1", "k2"]).join(other, ["e1", "e2"]).where(one_edit(F.col("words"), F.col("other")))
    return settle(verified.select("k1", "k2"), "near-lines")


def earlier_lines(documents: DataFrame) -> DataFrame:
    """doc_id, h, line_no of every line that is dropped (h: hash of the row's text)."""
    n = F.size("words")
    known = settle(_lines(documents).select("doc_id", "h", "line_no", *_keys(), _halves(F.col("words"), n).alias("halves"), (n > 0).alias("said")), "line-keys").where("said")
    again = known.groupBy("k1", "k2").agg(F.count("*").alias("lines")).where("lines > 1").select("k1", "k2", F.lit(False).alias("near"))
    asked = again.unionByName(_near(documents, known).withColumn("near", F.lit(True))).groupBy("k1", "k2").agg(F.max("near").alias("near"))
    asked = settle(asked, "asked-lines")
    found = bits.table(asked, "k1").keep(known.select("k1", "k2", "doc_id", "h", "line_no"), "k1").join(asked, ["k1", "k2"])
    found = settle(found, "found-lines")
    firsts = found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    return found.join(firsts, ["k1", "k2"]).where(F.col("near") | (F.col("first") < F.struct("doc_id", "line_no"))).select("doc_id", "h", "line_no")


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (ascending line numbers from 0) of every document."""
    drops = earlier_lines(documents).distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    out = rows.join(drops, ["doc_id", "h"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("dropped").alias("n_dropped"), "dropped")


def cleaned(documents: DataFrame) -> DataFrame:
    """The documents with their dropped lines taken out of the text; all columns stay."""
    d, h, dropped = (free_name(documents, n) for n in ("drop_id", "drop_hash", "drop_lines"))
    drops = earlier_lines(documents).distinct().groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.collect_set("line_no").alias(dropped))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(dropped, F.array().cast("array<int>")))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    out = documents.join(drops, (F.col("doc_id") == F.col(d)) & (F.xxhash64("text") == F.col(h)), "left")
    return out.withColumn("text", F.when(F.col(d).isNull(), F.col("text")).otherwise(text)).drop(d, h, dropped)
