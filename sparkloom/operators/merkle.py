"""Merkle trees over blocks of bytes: nodes in heap order, the root is 1 and leaves are [n, 2n).

A leaf is the digest of its block. An inner node is the digest of the byte-wise OR of
its two children. The count of blocks is padded to a power of two with digests of empty blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import settle

#: Name to digest size in bytes; `sum32` is a 32-bit OR of the block's words.
DIGESTS = {"sha256": 32, "sha384": 48, "sha512": 64, "sum32": 4}


def digest(data: bytes, kind: str) -> bytes:
    if kind == "sum32":
        words = np.frombuffer(data + b"\0" * (-len(data) % 4), "<u4")
        return int(np.bitwise_or.reduce(words)).to_bytes(4, "little") if len(words) else b"\0" * 4
    return hashlib.new(kind, data).digest()


def _either(left: bytes, right: bytes) -> bytes:
    return (np.frombuffer(left, np.uint8) | np.frombuffer(right, np.uint8)).tobytes()


def _root(leaves: list[bytes], kind: str) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(_either(a, b), kind) for a, b in zip(leaves[::2], leaves[1::2], strict=True)]
    return leaves[0]


def inner_root(data: bytes, kind: str) -> bytes:
    """Root of the tree over the block's chunks of one digest size, padded to a power of two with empty chunks."""
    size = DIGESTS[kind]
    chunks = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    chunks += [b""] * ((1 << (len(chunks) - 1).bit_length()) - len(chunks))
    return _root([digest(c, kind) for c in chunks], kind)


def tree(blocks: DataFrame, kind: str = "sha256", nested: bool = False) -> DataFrame:
    """blocks: block_id (dense from 0), data. Returns node_id, digest of all nodes; a level is a plan of its own."""
    n = blocks.count()
    if not n:
        return blocks.sparkSession.createDataFrame([], "node_id long, digest binary")
    width = 1 << (n - 1).bit_length()
    empty = inner_root(b"", kind) if nested else digest(b"", kind)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(inner_root if nested else digest)(x or b"", kind) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node_id", "digest"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [digest(_either(x, y), kind) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node_id", "digest"])

    schema = "node_id long, digest binary"
    level = blocks.select((F.col("block_id") + width).cast("long").alias("node_id"), F.col("data").cast("binary").alias("data")).mapInArrow(leaves, schema)
    if width > n:
        level = level.unionByName(blocks.sparkSession.range(width + n, 2 * width).select(F.col("id").alias("node_id"), F.lit(empty).alias("digest")))
    level = settle(level, "merkle")
    nodes = level
    while width > 1:
        width //= 2
        pairs = level.groupBy(F.shiftright("node_id", 1).alias("node_id")).agg(F.min_by("digest", "node_id").alias("left"), F.max_by("digest", "node_id").alias("right"))
        level = settle(pairs.mapInArrow(join, schema), "merkle")
        nodes = nodes.unionByName(level)
    return nodes
