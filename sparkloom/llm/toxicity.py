"""Toxicity: a logistic classifier over word and word-beginning features, regularised by counterfactual identity swaps.

A text's features are the distinct hashed words and word beginnings of four and
five bytes. The classifier is fitted on a bounded sample of labelled rows
(`sample`, taken by a hash of the id), with the `features` that tell the labels apart best. In each sampled text that names a group
the term is swapped, wherever it stands, for every other term of its list, and the squared change of
the text's log-odds is added to the loss, so that the score depends on what is said and not on
who is named. All texts are scored whole, long ones included, in memory that follows the longest text.

Null and empty texts have no features and get the score of the bias alone; ties of features go by their number. Repeated rows are scored each by
itself; of rows that repeat a sampled id the one with the least text is learnt from. Without labelled rows every score is that of a
fixed small bias, and an empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _LOWER, cut_rows, mix64, span_hashes, word_spans
from .store import fold

BITS = 18
BEGINNINGS = (4, 5)

# Neutral names of groups; each list holds terms that can stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)

# A word is a run of letters, digits, apostrophes and bytes beyond ASCII.
_INK = np.zeros(256, bool)
_INK[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'", np.uint8)] = True
_INK[128:] = True


def _occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and bucket of every feature occurrence; and the hash of each word."""
    starts, ends, first = word_spans(data, offsets, _INK)
    data = _LOWER[data]
    rows, place = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.arange(len(starts))
    words = span_hashes(data, starts, ends)
    at, out = [place], [words]
    for k in BEGINNINGS:
        long = ends - starts > k
        at.append(place[long])
        out.append(mix64(span_hashes(data, starts[long], starts[long] + k) + np.uint64(k)))
    at = np.concatenate(at)
    return rows[at], at, (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), words


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, _, buckets, _ = _occurrences(data, offsets)
    return rows, buckets


def _features(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(_buckets(data, np.array([0, len(data)]))[1])


@cache
def _terms() -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """By the hash of each group term: its features, and those of the other terms of its list."""
    out = {}
    for terms in IDENTITY_TERMS:
        own = [(_occurrences(data := np.frombuffer(t.encode(), np.uint8), np.array([0, len(data)]))[3][0], _features(t)) for t in terms]
        out |= {int(h): (f, [g for i, g in own if i != h]) for h, f in own}
    return out


def _swapped(rest: np.ndarray, term: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each swap of the term in a text whose other words have the features `rest`: the features that come, and those that go."""
    own, others = _terms()[term]
    base = np.union1d(rest, own)
    return [(np.setdiff1d(other, base), np.setdiff1d(np.setdiff1d(own, rest), other)) for other in others]


def swaps(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each text its swaps: of each group term that it names, for each other one of the list."""
    rows, at, buckets, words = _occurrences(data, offsets)
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(offsets) - 1)]
    known = np.array(sorted(_terms()), np.uint64)
    named = np.isin(words, known)[at]
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(len(offsets)))
    for row in np.unique(rows[named]).tolist():
        mine = order[first[row] : first[row + 1]]
        for term in np.unique(words[at[mine[named[mine]]]]).tolist():
            out[row] += _swapped(np.unique(buckets[mine[words[at[mine]] != np.uint64(term)]]), term)
    return out


def _swaps_of_lists(lists: list[np.ndarray]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """As swaps(), where only features are known: those of a named term are taken to come from it alone."""
    return [[s for term, (own, _) in _terms().items() if int(term) >> (64 - BITS) in set(x.tolist()) for s in _swapped(np.setdiff1d(x, own), term)] for x in lists]


_CHANGE = pa.list_(pa.struct([("come", pa.list_(pa.int32())), ("go", pa.list_(pa.int32()))]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in cut_rows(batch, "text"):
            rows, buckets = _buckets(data, offsets)
            got = np.unique(rows << BITS | buckets)
            ends = np.searchsorted(got, np.arange(part.num_rows + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((got & ((1 << BITS) - 1)).astype(np.int32)))
            changes = pa.array([[{"come": p.tolist(), "go": m.tolist()} for p, m in own] for own in swaps(data, offsets)], _CHANGE)
            yield pa.RecordBatch.from_arrays([part.column(1), lists, changes], names=["toxic", "features", "swaps"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, buckets = _buckets(data, offsets)
        told = self.weights[buckets] != 0
        seen = np.unique(rows[told] << BITS | buckets[told])
        z = self.bias + np.bincount(seen >> BITS, self.weights[seen & ((1 << BITS) - 1)], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def swap_loss(model: Model, changes: list[list[tuple[np.ndarray, np.ndarray]]]) -> float:
    """The penalty before its factor: squared changes of the log-odds, summed over each text's swaps, a mean over texts."""
    return sum(float(model.weights[p].sum() - model.weights[m].sum()) ** 2 for own in changes for p, m in own) / max(1, len(changes))


def fit_rows(labels: np.ndarray, lists: list[np.ndarray], changes: list[list[tuple[np.ndarray, np.ndarray]]] | None = None, features: int = 8192, swap: float = 1.0, ridge: float = 2e-4, rounds: int = 300) -> Model:
    """Logistic regression with a ridge and `swap` times the swap_loss, by gradient steps with momentum (Adam)."""
    changes = _swaps_of_lists(lists) if changes is None else changes
    y = np.asarray(labels, float)
    n = len(y)
    if not n or y.min() == y.max():
        return Model(np.zeros(1 << BITS), float(np.clip(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), -5, 5)) if n else -5.0)
    rows = np.repeat(np.arange(n), [len(x) for x in lists])
    flat = np.concatenate(lists).astype(np.int64)
    pos, all_ = np.bincount(flat, y[rows], 1 << BITS), np.bincount(flat, minlength=1 << BITS)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((all_ - pos + 0.5) / (n - y.sum() + 1))
    worth = np.where(all_ >= 3, np.abs(odds) * np.sqrt(all_), 0)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:features])
    chosen = chosen[worth[chosen] > 0]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[flat] >= 0
    rows, cols = rows[keep], place[flat[keep]]

    # Of each swap the places whose weights are added to the change of its text's log-odds, or taken from it.
    flat_swaps = [x for own in changes for x in own]

    def side(k: int) -> tuple[np.ndarray, np.ndarray]:
        at = place[np.concatenate([x[k] for x in flat_swaps]).astype(np.int64)] if flat_swaps else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(flat_swaps)), [len(x[k]) for x in flat_swaps])
        return at[at >= 0], of[at >= 0]

    (come, of_come), (go, of_go) = side(0), side(1)
    told = len(flat_swaps)

    w, bias = np.zeros(len(chosen) + 1), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    sure = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum()))) ** 0.5  # a part of the imbalance is taken out
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], n) + w[-1]
        e = sure * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.append(np.bincount(cols, e[rows], len(chosen)) + ridge * w[:-1], e.sum())
        change = np.bincount(of_come, w[come], told) - np.bincount(of_go, w[go], told)
        pull = 2 * swap / n * change
        g[:-1] += np.bincount(come, pull[of_come], len(chosen)) - np.bincount(go, pull[of_go], len(chosen))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    full = np.zeros(1 << BITS)
    full[chosen] = w[:-1]
    return Model(full, float(w[-1]))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 16_000, **options) -> Model:
    """labels: doc_id, toxic (0 or 1). The texts of at most `sample` labelled ids, those of the smallest hash, reach the driver as lists of buckets."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most are broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = rows.select("text", "toxic").mapInArrow(_featurise, "toxic int, features array<int>, swaps array<struct<come:array<int>,go:array<int>>>").toArrow()
    changes = [[(np.array(c["come"], np.int64), np.array(c["go"], np.int64)) for c in own] for own in got["swaps"].to_pylist()]
    lists = [x.values.to_numpy() for x in got["features"]]
    return fit_rows(got["toxic"].to_numpy(), lists, changes, **options)


def apply(documents: DataFrame, model: Model) -> DataFrame:
    """documents: doc_id, text. Returns doc_id, score, predicted; a row for each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the corpus

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in cut_rows(batch, "text"):
                s = shared.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, with labels learnt only outside the held-out fold.

    A document labelled more than once counts with its greatest label.
    """
    model = fit(documents, labels.where(fold("doc_id", folds) != 0), **options)
    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(False))
    return apply(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted")
