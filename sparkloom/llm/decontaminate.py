"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words: the words at its 1s are hashed,
those at its 0s are ignored, so a hit survives substitutions there. The seeds are
chosen together so that every overlap (a stretch of at least `SPAN` words on one
diagonal that begins and ends with equal words, 0.8 of all equal) has a hit of one
of them inside; a test walks all patterns of equal words to prove it.
Windows of test items and of documents are joined on (mask, hash). Around each
hit the words of document and item are compared along the hit's diagonal, and the
longest stretch with at least 0.8 equal words (`MATCH` against `MISS`) is an
overlap if it has `least` words. Items of fewer than `SPAN` words must occur whole, with 0.8 of their words equal,
whichever these are; they have seeds of their own. So items of 3 or 4 words must occur exactly. Items with fewer
words are no evidence and are left out.

Documents are scanned once against a Bloom filter of the item windows; what passes it
is cut into runs of hits that carry their own words, as far before and behind as the longest item could reach from a hit: so no overlap is cut short.
Only these runs are shuffled to the item windows, and of a run only the words that lie along an item go on to it. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered.

Null or empty texts overlap with nothing; rows without an id take no part; repeated ids are one document or item, and equal items under
several ids are all named. A long text is searched whole; its runs are as long as its hits and the longest item ask for. Without documents or items there is no
overlap. Of equally long overlaps the first counts. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits, bloom
from .kernel import cut_rows, mix64, window_hashes, word_hashes
from .store import free_name, settle

# Seeds of weight 7 that leave no overlap of SPAN words or more without a hit.
SEEDS = ("11101111", "1111010011", "10100101111", "11010101011", "110110011001", "111000000010111")
SPAN = 12
# For each shorter item by its number of words: seeds of which one ignores all places that may differ.
SHORT_SEEDS = (
    "111", "1111",
    "11110", "11101", "11011", "10111", "01111",
    "111100", "110011", "001111",
    "1111100", "1110011", "1001111", "0111110",
    "11111000", "11000111", "00111110",
    "111111000", "111000111", "000111111",
    "1111100000", "1000011110", "0110011001", "0001100111", "1110000110", "1001111000", "0111110000",
    "11111000000", "00000111110", "11000110001", "10000001111", "00111100001", "01111010000",
)
SHORTEST = 3
MATCH, MISS = 1, -4


def _masks() -> list[tuple[int, tuple[int, ...], int]]:
    """Number, positions and width of each mask; the later ones are for items of fewer words than SPAN."""
    return [(k, tuple(i for i, c in enumerate(s) if c == "1"), len(s)) for k, s in [*enumerate(SEEDS), *enumerate(SHORT_SEEDS, 100)]]


def _windows(words: np.ndarray, mask: tuple[int, tuple[int, ...], int]) -> np.ndarray:
    number, slots, width = mask
    return mix64(window_hashes(words, slots, width) + np.uint64(number + 1))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in cut_rows(batch, "text"):
            words, first = word_hashes(data, offsets)
            own = [words[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "n", "words"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    for batch in batches:
        ids, names = batch.column(0), ["hash", "mask", "item_id", "n", "at"]
        for k, blob in enumerate(batch.column("words")):
            own = np.frombuffer(blob.as_buffer(), np.uint64)
            for mask in masks:
                whole = mask[0] >= len(SEEDS)  # a mask for short items
                if len(own) < SHORTEST or (len(own) != mask[2] if whole else len(own) < max(SPAN, mask[2])):
                    continue
                h = _windows(own, mask)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, mask[0], np.int32)), ids.take(pa.array(np.full(n, k))), pa.array(np.full(n, len(own))), pa.array(np.arange(n))], names=names)


def _runs(bitmap, masks: list, reach: int) -> "callable":
    """doc_id, text -> rows (doc_id, start, words, hits): hits no further apart than `reach` words share a run, which carries as many beyond them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, widest = bitmap.value, max(m[2] for m in masks)
        for batch in batches:
            for part, data, offsets in cut_rows(batch, "text"):
                words, first = word_hashes(data, offsets)
                at, mask_of, hash_of = [], [], []
                for mask in masks:
                    h = _windows(words, mask)
                    hit = bloom.passes(bits, h)
                    row = np.searchsorted(first, hit, "right") - 1
                    hit = hit[hit + mask[2] <= first[row + 1]]
                    at.append(hit)
                    mask_of.append(np.full(len(hit), mask[0], np.int32))
                    hash_of.append(h[hit])
                at, mask_of, hash_of = (np.concatenate(x) for x in (at, mask_of, hash_of))
                order = np.argsort(at, kind="stable")
                at, mask_of, hash_of = at[order], mask_of[order], hash_of[order].view(np.int64)
                row = np.searchsorted(first, at, "right") - 1
                cut = np.flatnonzero(np.append(True, (np.diff(at) > reach) | (np.diff(row) != 0))) if len(at) else []
                ids = part.column(0)
                for a, b in zip(cut, [*cut[1:], len(at)], strict=False):
                    lo, hi = first[row[a]], first[row[a] + 1]
                    lo, hi = max(lo, at[a] - reach), min(hi, at[b - 1] + widest + reach)
                    hits = [{"hash": h, "mask": m, "at": p} for h, m, p in zip(hash_of[a:b].tolist(), mask_of[a:b].tolist(), (at[a:b] - lo).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(int(row[a]), 1), pa.array([int(lo - first[row[a]])], pa.int64()), pa.array([words[lo:hi].tobytes()], pa.binary()), pa.array([hits], pa.list_(pa.struct([("hash", pa.int64()), ("mask", pa.int32()), ("at", pa.int64())])))],
                        names=["doc_id", "start", "words", "hits"])

    return found


def longest_overlap(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch [a, b) that begins and ends with equal words and whose MATCH and MISS sum to 0 or more, first of equals."""
    if not equal.any():
        return 0, 0
    sums = np.append(0, np.cumsum(np.where(equal, MATCH, MISS)))
    least = np.minimum.accumulate(np.where(equal, sums[:-1], len(equal) + 1))  # over starts at equal words
    ends = np.flatnonzero(equal) + 1
    # least falls, so the first start that is low enough is found by bisection.
    start = np.searchsorted(-least, -sums[ends], "left")
    k = int((ends - start).argmax())
    return int(start[k]), int(ends[k])


def _verify(least: int):
    """doc_id, item_id, item_words, from_word, words, skipped -> overlaps; `words` lie along the item from its word `skipped` on."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, spans = [], []
            columns = (batch.column(c) for c in ("from_word", "words", "item_words", "skipped"))
            for k, (start, own, item, skipped) in enumerate(zip(*columns, strict=True)):
                own, item, start, skipped = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64), start.as_py(), skipped.as_py()
                equal = own == item[skipped : skipped + len(own)]
                a, b = longest_overlap(equal)
                if b - a >= min(least, len(item)):
                    keep.append(k)
                    spans.append((start + a, start + b))
                elif len(item) < SPAN and len(own) == len(item) and np.where(equal, MATCH, MISS).sum() >= 0:
                    keep.append(k)
                    spans.append((start, start + len(own)))
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("doc_id"), got.column("item_id"), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64())], names=["doc_id", "item_id", "from_word", "to_word"])

    return checked


def overlaps(documents: DataFrame, benchmark: DataFrame, least: int = SPAN) -> DataFrame:
    """doc_id, item_id, from_word, to_word: verified overlaps (distinct rows; several for an item that occurs again)."""
    spark = documents.sparkSession
    doc_type, item_type = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = settle(benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(_item_words, f"item_id {item_type}, n long, words binary").where(F.col("n") >= SHORTEST).distinct(), "items")
    windows = settle(items.mapInArrow(_item_windows, f"hash long, mask int, item_id {item_type}, n long, at long"), "item-windows")
    told = windows.agg(F.collect_set("mask").alias("masks"), F.max("n").alias("longest")).first()  # at most as many as masks
    bitmap = spark.sparkContext.broadcast(bloom.build(windows, "hash"))
    masks = [m for m in _masks() if m[0] in told["masks"]] or _masks()[:1]
    runs = documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        _runs(bitmap, masks, told["longest"] or 0), f"doc_id {doc_type}, start long, words binary, hits array<struct<hash:long,mask:int,at:long>>")
    runs = settle(runs, "hit-runs")
    bitmap.destroy()
    hits = runs.select("doc_id", "start", F.explode("hits").alias("hit")).select("doc_id", "start", "hit.*")
    keys = windows.select("hash", "mask", "item_id", "n", F.col("at").alias("item_at"))
    pairs = hits.join(keys, ["hash", "mask"]).select("doc_id", "start", "item_id", "n", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    # Of the run's words those along the item: 8 bytes each, from word `low` of the run on.
    low = F.greatest(F.lit(0), F.col("diagonal"))
    along = F.substring("words", (8 * low + 1).cast("int"), (8 * (F.col("diagonal") + F.col("n") - low)).cast("int"))
    met = pairs.join(runs.select("doc_id", "start", "words").distinct(), ["doc_id", "start"]).select("doc_id", "item_id", "n", (F.col("start") + low).alias("from_word"), along.alias("words"), (low - F.col("diagonal")).alias("skipped"))
    full = met.join(items.select("item_id", "n", F.col("words").alias("item_words")), ["item_id", "n"])
    return full.select("doc_id", "item_id", "item_words", "from_word", "words", "skipped").mapInArrow(_verify(least), f"doc_id {doc_type}, item_id {item_type}, from_word long, to_word long").distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, least: int = SPAN) -> DataFrame:
    """Only the documents with an overlap: doc_id, item_ids (ascending list), n_items, longest (words of the longest overlap)."""
    found = overlaps(documents, benchmark, least).groupBy("doc_id", "item_id").agg(F.max(F.col("to_word") - F.col("from_word")).alias("words"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.count("*").alias("n_items"), F.max("words").alias("longest"))


def without(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all columns, whose id is not in `found`, a settled table; only rows that the bits of those ids let through are shuffled."""
    mark = free_name(documents)
    marked = bits.table(found, "doc_id").flag(documents, "doc_id", mark)
    kept = marked.where(F.col(mark)).drop(mark).join(found.select("doc_id"), "doc_id", "left_anti")
    return marked.where(~F.col(mark)).drop(mark).unionByName(kept).select(*documents.columns)
