"""Language identification by rank-order n-gram profiles.

A profile is the `size` most frequent n-grams (n = 1..3, runs of non-letters as one
boundary) in falling order of count, ties by n and then code points. A
language's profile is counted over all its training documents; a document is
given the language whose profile has the least out-of-place distance from the
document's own: the sum over the document's n-grams of the rank difference, and
`size` for an n-gram that the profile lacks.

score = 1 - distance / (size * n-grams of the document's profile), from 0 to 1.
Null texts and texts without a letter are `und` with score 0, and so is
everything where nothing was learnt. Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import cut_rows
from .store import fold

SIZE = 300
SHIFT = 21  # bits of a code point in the key of an n-gram: 3 of them and, above, nothing


@cache
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one 0 for each run of other characters, and the row of each; two 0 close a row, one opens it."""
    joined = "\0".join(t.replace("\0", " ").lower() for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(raw == 0)
    rows = np.zeros(len(raw), np.int64)
    rows[ends] = 1
    rows = np.cumsum(rows)
    code = _letters()[raw]
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep[ends] = False
    code, rows = code[keep], rows[keep]
    n = len(texts)
    # Boundaries: a leading 0 unless one is there, and a trailing one, then one more.
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    some = counts > 0
    lead, tail = np.zeros(n, bool), np.zeros(n, bool)
    lead[some] = code[first[some]] != 0
    tail[some] = code[first[some] + counts[some] - 1] != 0
    before, after = lead.astype(np.int64), np.where(some, 1 + tail, 0)
    sizes = counts + before + after
    out = np.zeros(int(sizes.sum()), np.uint32)
    offset = np.cumsum(sizes) - sizes + before - first
    out[np.arange(len(code)) + np.repeat(offset, counts)] = code
    return out, np.repeat(np.arange(n), sizes)


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows before, row, key, count) of the distinct n-grams of runs of rows, in order of row, then n, then code points.

    A key holds n code points of `SHIFT` bits, the first one highest; n is told by the boundary rules:
    a unigram is a letter, a bigram's first place is shifted once, a trigram's twice, and absent places are 0x1FFFFF.
    """
    codes, rows = _codes(texts)
    if not len(codes):
        return
    known = np.unique(codes)
    bits, row_bits = max(1, int(len(known) - 1).bit_length()), max(1, len(texts) - 1).bit_length()
    if 3 * bits + row_bits > 63 and len(texts) > 1:
        half = len(texts) // 2
        yield from _grams(texts[:half])
        for base, *rest in _grams(texts[half:]):
            yield base + half, *rest
        return
    place = np.zeros(int(known[-1]) + 1, np.int64)
    place[known] = np.arange(len(known))
    zero = 1 if known[0] == 0 else 0
    c = place[codes]
    same = rows[2:] == rows[:-2]
    three = np.sort((rows[:-2] << 3 * bits | c[:-2] << 2 * bits | c[1:-1] << bits | c[2:])[same])

    def counted(sorted_: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        return sorted_[at], np.diff(np.append(at, len(sorted_))) if weights is None else np.add.reduceat(weights, at)

    if not len(three):
        return
    k3, n3 = counted(three, None)
    # Each n-gram begins one trigram, for a row ends in two boundaries: so shorter ones are sums over beginnings.
    k2, n2 = counted(k3 >> bits, n3)
    k1, n1 = counted(k2 >> bits, n2)
    mask = (1 << bits) - 1
    if zero:
        one = (k1 & mask) != 0
        two = ((k2 >> bits & mask) != 0) | ((k2 & mask) != 0)
        tri = (k3 >> bits & mask) != 0  # `x_y` spans a boundary, `__x` and `x__` say no more than a bigram
        k1, n1, k2, n2, k3, n3 = k1[one], n1[one], k2[two], n2[two], k3[tri], n3[tri]
    absent = (1 << SHIFT) - 1
    wide = known.astype(np.int64)
    row = np.concatenate([k1 >> bits, k2 >> 2 * bits, k3 >> 3 * bits])
    key = np.concatenate([
        absent << 2 * SHIFT | absent << SHIFT | wide[k1 & mask],
        absent << 2 * SHIFT | wide[k2 >> bits & mask] << SHIFT | wide[k2 & mask],
        wide[k3 >> 2 * bits & mask] << 2 * SHIFT | wide[k3 >> bits & mask] << SHIFT | wide[k3 & mask],
    ])
    count = np.concatenate([n1, n2, n3])
    size = np.concatenate([np.zeros(len(k1), np.int8), np.ones(len(k2), np.int8), np.full(len(k3), 2, np.int8)])
    order = np.lexsort((size, row)) if len(texts) > 1 else np.arange(len(row))
    yield 0, row[order], key[order], count[order]


def _length(key: np.ndarray) -> np.ndarray:
    absent = (1 << SHIFT) - 1
    return 1 + ((key >> SHIFT & absent) != absent).astype(int) + ((key >> 2 * SHIFT) != absent)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, key, n: summed over each run of rows."""
    for batch in batches:
        for part, _, _ in cut_rows(batch, "text"):
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs])
            texts = [x or "" for x in part.column(1).to_pylist()]
            for k, name in enumerate(names):
                sums: dict[int, int] = {}
                for _, _, keys, counts in _grams([t for t, o in zip(texts, own, strict=True) if o == k]):
                    u, inverse = np.unique(keys, return_inverse=True)
                    for key, n in zip(u.tolist(), np.bincount(inverse, counts).astype(np.int64).tolist(), strict=True):
                        sums[key] = sums.get(key, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums), pa.string()), pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["lang", "key", "n"])


def profiles(labelled: DataFrame, size: int = SIZE) -> dict[str, list[int]]:
    """labelled: lang, text. The keys of each language's profile, most frequent first: `size` numbers a language reach the driver."""
    counts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    absent = (1 << SHIFT) - 1
    length = F.when(F.shiftright("key", 2 * SHIFT) != absent, 3).when(F.shiftright("key", SHIFT).bitwiseAND(F.lit(absent)) != absent, 2).otherwise(1)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "length", "key")
    ranked = counts.withColumn("length", length).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "key", "rank").collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["key"])
    return found


class Judge:
    def __init__(self, learnt: dict[str, list[int]], size: int = SIZE):
        self.size, self.names = size, sorted(learnt)
        self.keys = np.unique(np.array([k for v in learnt.values() for k in v], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, learnt[name]), j] = np.arange(len(learnt[name]))

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for base, row, key, count in _grams(texts) if self.names else ():
            # By row, then falling count, then the order in which they come: one sort of a packed number.
            bits = max(1, int(len(key)).bit_length())
            most = (1 << max(1, 63 - bits - int(row[-1]).bit_length())) - 1
            order = np.sort(row.astype(np.uint64) << np.uint64(63 - int(row[-1]).bit_length()) | (most - np.minimum(count, most)).astype(np.uint64) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
            order = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
            row, key = row[order], key[order]
            first = np.searchsorted(row, row)
            rank = np.arange(len(row)) - first
            top = rank < self.size
            row, key, rank = row[top], key[top], rank[top]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            theirs = self.ranks[np.where(self.keys[at] == key, at, len(self.keys))]
            out = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sums, n = np.add.reduceat(out, starts, axis=0), np.diff(np.append(starts, len(row)))
            least = sums.argmin(axis=1)
            best[base + row[starts]] = least
            score[base + row[starts]] = 1 - sums[np.arange(len(starts)), least] / (self.size * n)
        return [self.names[b] if b >= 0 else "und" for b in best.tolist()], score


def identify(documents: DataFrame, learnt: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    judge = documents.sparkSession.sparkContext.broadcast(Judge(learnt, size))  # `size` numbers a language

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in cut_rows(batch, "text"):
                langs, score = judge.value([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(judged, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(documents: DataFrame, folds: int = 4, held: int = 2, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; profiles are learnt outside the held-out fold."""
    learnt = profiles(documents.where(fold("doc_id", folds) != held), size)
    out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    return identify(documents, learnt, size).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def told(documents: DataFrame, learnt: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """The documents, all columns, whose language is told: those that `identify` would call `und` go."""
    judge = documents.sparkSession.sparkContext.broadcast(Judge(learnt, size))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in cut_rows(batch, "text"):
                langs, _ = judge.value([x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()])
                yield part.filter(pa.array([x != "und" for x in langs], pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
