"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are scaled to length 1 and rounded to int8 with one step size each. A
tile holds some thousand of them; each query tile meets each candidate tile
once. The int8 product gives every cosine up to a proven error: with
x = x' + r, |x.y - x'.y'| <= |x'| |r_y| + |r_x|. A pair survives
while its upper bound reaches the k-th greatest lower bound of its query, and the k-th exact score that is known;
survivors are recomputed in double precision from the original vectors, some thousand at a time, and go to one heap of
size k for each query of the tile pair. The heaps' rows are merged into the k best of each query. Nothing is approximate in the result.

Vectors that are null, zero, or hold a null or a non-finite component take no part;
only vectors of equal dimension are compared. Rows are told apart by their id: a query never
meets its own id, and repeated rows of an id count once, with the best score. Equal scores go by the smaller id, however many
there are: they cost time but no memory. A tile holds fewer vectors the longer they are. Without queries or candidates there are no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE, QUERY_TILE, CHUNK = 16_384, 512, 2_048
DIMENSION = 1_024  # vectors with more components come in smaller tiles
PAIRS = 1 << 20  # components of the pairs that are recomputed at once
_TILE_SCHEMA = "dim int, tile long, ids binary, vectors binary, steps binary, lengths binary, errors binary, ints binary"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, step of each, length of the rounded row, length of the rest (both rounded up)."""
    step = np.abs(unit).max(axis=1) / 127
    ints = np.rint(unit / step[:, None]).astype(np.int8)
    rounded = ints * step[:, None]
    return ints, step, np.sqrt((rounded**2).sum(axis=1)) + 1e-9, np.sqrt(((unit - rounded) ** 2).sum(axis=1)) + 1e-9


def _tiles(size: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            wide = rows.astype(np.float64)
            top = np.abs(wide).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
            wide /= top
            unit = wide / np.sqrt((wide**2).sum(axis=1, keepdims=True))
            ints, *sizes = quantise(unit)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, rows, *sizes, ints))], names=["dim", "tile", "ids", "vectors", "steps", "lengths", "errors", "ints"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            for dim in np.unique(dims[dims > 0]).tolist():
                rows = np.flatnonzero((dims == dim) & ~np.asarray(lists.is_null()))
                if not len(rows):
                    continue
                vectors = flat[ends[rows][:, None] + np.arange(dim)]
                good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
                rows, vectors = rows[good], vectors[good]
                step = max(1, size * DIMENSION // max(dim, DIMENSION))
                for i in range(0, len(rows), step):
                    held.setdefault(dim, []).append((ids[rows[i : i + step]], vectors[i : i + step]))
                    if sum(len(x) for x, _ in held[dim]) * max(dim, DIMENSION) >= size * DIMENSION:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return packed


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision, each summed from the first dimension to the last."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        a, b = x[:, d], y[:, d]
        dot += a * b
        xx += a * a
        yy += b * b
    with np.errstate(all="ignore"):
        out = dot / (np.sqrt(xx) * np.sqrt(yy))
    odd = ~np.isfinite(out) | (xx < 1e-280) | (yy < 1e-280)
    if odd.any():  # squares that overflow or vanish: scale first
        a, b = x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True), y[odd] / np.abs(y[odd]).max(axis=1, keepdims=True)
        out[odd] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return out


class Heaps:
    """The k best candidates of each query: heaps of (score, -id), the worst on top. An id stands once, with its best score."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(queries)]
        self.score, self.id = np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)  # of the tops of full heaps

    def wanted(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> np.ndarray:
        top = self.score[query]
        return (score > top) | ((score == top) & (vec < self.id[query]))

    def push(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        for at in np.split(np.arange(len(query)), range(64, len(query), 64)):  # so that the tops are looked at again
            at = at[self.wanted(query[at], score[at], vec[at])]
            for q, s, v in zip(query[at].tolist(), score[at].tolist(), vec[at].tolist(), strict=True):
                heap, item = self.heaps[q], (s, -v)
                twin = next((j for j, (_, w) in enumerate(heap) if w == -v), None)
                if twin is not None:
                    if s > heap[twin][0]:
                        heap[twin] = item
                        heapify(heap)
                elif len(heap) < self.k:
                    heappush(heap, item)
                elif item > heap[0]:
                    heapreplace(heap, item)
                if len(heap) == self.k:
                    self.score[q], self.id[q] = heap[0][0], -heap[0][1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [(q, -v, s) for q, heap in enumerate(self.heaps) for s, v in heap]
        return tuple(np.array([x[c] for x in flat], t) for c, t in enumerate((np.int64, np.int64, np.float64)))


def _meet(k: int):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                f = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                dim = f["dim"]
                kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # so integer sums are exact

                def side(p: str) -> tuple[np.ndarray, ...]:
                    return (np.frombuffer(f[p + "ids"], np.int64), np.frombuffer(f[p + "vectors"]).reshape(-1, dim), *(np.frombuffer(f[p + x]) for x in ("steps", "lengths", "errors")), np.frombuffer(f[p + "ints"], np.int8).reshape(-1, dim))

                qid, qvec, qstep, qlen, qerr, qint = side("q_")
                cid, cvec, cstep, clen, cerr, cint = side("")
                left = qint.astype(kind)
                low = np.full((len(qid), k), -np.inf)
                heaps, step = Heaps(len(qid), k), max(1, PAIRS // dim)
                for i in range(0, len(cid), CHUNK):
                    part = slice(i, i + CHUNK)
                    near = (left @ cint[part].astype(kind).T).astype(np.float64) * qstep[:, None] * cstep[part]
                    slack = qlen[:, None] * cerr[part] + qerr[:, None] + 1e-9
                    own = qid[:, None] == cid[part]
                    # Repeats of an id must not fill the k places: only the first of each counts for the bound.
                    first = np.zeros(len(cid[part]), bool)
                    first[np.unique(cid[part], return_index=True)[1]] = True
                    lower = np.where(own | np.isin(cid[part], cid[:i]), -np.inf, near - slack)[:, first]
                    low = -np.sort(-np.concatenate([low, lower], axis=1), axis=1)[:, :k]
                    upper = near + slack
                    a, b = np.nonzero((upper >= low[:, -1:]) & ~own)
                    upper, b = upper[a, b], b + i
                    order = np.lexsort((cid[b], -upper))  # the likeliest first, so that heaps fill with what stays
                    a, b, upper = a[order], b[order], upper[order]
                    for j in range(0, len(a), step):
                        some = slice(j, j + step)
                        live = upper[some] >= heaps.score[a[some]]
                        x, y = a[some][live], b[some][live]
                        heaps.push(x, exact(qvec[x], cvec[y]), cid[y])
                query, vec, score = heaps.rows()
                yield pa.RecordBatch.from_arrays([pa.array(qid[query]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return products


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of greatest cosine, ties to the smaller id."""
    spark = candidates.sparkSession
    own = [F.col(key).cast("long").alias("id"), F.col(vector).alias("v")]
    right = candidates.where(F.col(key).isNotNull()).select(own).mapInArrow(_tiles(TILE), _TILE_SCHEMA)
    left = queries.where(F.col(key).isNotNull()).select(own).mapInArrow(_tiles(QUERY_TILE), _TILE_SCHEMA)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = left.select("dim", *[F.col(c).alias("q_" + c) for c in left.columns if c != "dim"], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = right.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    pairs = right.join(left, ["dim", "part"]).drop("part", "tile", "q_tile").mapInArrow(_meet(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The rows whose id is divisible by `every` against all rows."""
    return nearest(embeddings.where(F.col("vec_id") % every == 0), embeddings, k)
