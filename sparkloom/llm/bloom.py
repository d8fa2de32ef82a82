"""A Bloom filter over 64-bit hashes for Python workers, built on the executors; its size follows from the number of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EACH = 256  # bits a value: many more hashes are asked than are put in, and one in some 600,000 passes that should not
LEAST, MOST = 16, 30  # 2**MOST bits, 128 MB: with more than some 4 million values it passes more, and never less than it must
_PIECES = 1 << 8


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three of 2**bits bits of each hash (uint64)."""
    return [(hashes >> np.uint64(s) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in (0, 17, 34)]


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose three bits are set."""
    found, bits = np.arange(len(hashes)), (8 * len(filter_)).bit_length() - 1
    for k in range(3):
        at = places(hashes[found], bits)[k]
        found = found[(filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1]
    return found


def build(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a settled table's long column: partitions give pieces, which the executors merge; 128 MB at most reach the driver."""
    bits = min(MOST, max(LEAST, (EACH * df.count()).bit_length()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for at in places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        packed = packed.reshape(_PIECES, -1)
        used = np.flatnonzero(packed.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[k].tobytes() for k in used], pa.binary())], names=["piece", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = 0, np.zeros(0, np.uint8)
        for b in batches:
            for x in b.column("bits"):
                own = np.frombuffer(x.as_py(), np.uint8)
                total = total | own if len(total) else own
            piece = b.column("piece")[0].as_py() if b.num_rows else piece
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "bits"])

    found = df.where(F.col(column).isNotNull()).select(column).mapInArrow(pieces, "piece int, bits binary").groupBy("piece").applyInArrow(merged, "piece int, bits binary")
    out = np.zeros((_PIECES, (1 << (bits - 3)) // _PIECES), np.uint8)
    for r in found.collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def maybe(df: DataFrame, column: str, bits: np.ndarray, name: str) -> DataFrame:
    """df with a boolean column `name`: whether the long in `column` may be in the filter; null is not."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        out = np.zeros(len(values), bool)
        good = np.asarray(values.is_valid())
        out[np.flatnonzero(good)[passes(shared.value, values.fill_null(0).to_numpy(zero_copy_only=False)[good].view(np.uint64))]] = True
        return pa.array(out)

    return df.withColumn(name, test(F.col(column)))
