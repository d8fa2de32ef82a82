"""Token-id output: fixed-width bit packing with block offsets.

A data set is a folder of Parquet part files in ascending order of the document
id. A row is a block of whole documents of about `block` ids:

    shard int, block int         place of the block; shards follow the order of ids
    bits int                     width of an id: the fewest bits that hold every id below the vocabulary's size
    doc_ids list, ends list      the documents of the block, and where each one's ids end, counted in ids
    payload binary               the ids, `bits` bits each, least significant bit first, closed by zero bits

So document k of a block is ids [ends[k-1], ends[k]), which start at bit ends[k-1] * bits
of the payload: any document, or any run of ids, is unpacked by numpy without what comes before it.
Spark's committer writes the files, so a lost executor's tasks are written again.

Null texts count as empty; every document ends with the id `end`. Repeated ids keep
all their rows, adjacent, in an order that depends on the ids themselves; documents without an id come first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import cut_rows, mix64, span_hashes, tidy, word_spans
from .store import new_path

#: Units kept with their ids in each Python worker, and eight times as many ids of theirs, some 70 bytes a unit at most: a matter of speed only.
#: Workers keep them between stages, and what they hold counts against their executor.
MEMORY = 400_000


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, `bits` bits each, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a payload, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[start:stop].astype("<u4")
    first, last = start * bits // 8, -(-stop * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8)[first:last], bitorder="little")[start * bits - 8 * first :]
    planes = flat[: (stop - start) * bits].reshape(stop - start, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


# Bytes that are white space but neither space nor line end, and which bytes follow the first byte of the others.
_ODD = np.zeros(256, bool)
_ODD[[0x00, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_ODD_TWO = (0xC285, 0xC2A0)
_ODD_THREE = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with any white space but single spaces and line ends between other characters."""
    gap = _GAP[data]
    at = [np.flatnonzero(_ODD[data])]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        code = np.append(data, [0, 0]).astype(np.int64)
        code = code[lead] << 16 | code[lead + 1] << 8 | code[lead + 2]
        at.append(lead[np.isin(code >> 8, _ODD_TWO) | np.isin(code, _ODD_THREE)])
    twin = np.flatnonzero(gap[1:] & gap[:-1]) + 1
    at.append(twin[offsets[np.searchsorted(offsets, twin)] != twin] if len(twin) else twin)
    some = offsets[:-1] < offsets[1:]
    at += [offsets[:-1][some][gap[offsets[:-1][some]]], offsets[1:][some][gap[offsets[1:][some] - 1]] - 1]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
    return odd


class Encoder:
    """Ids of whole texts by a byte-level BPE of the `tokenizers` library.

    The library cuts a text into pieces before it merges bytes, and always cuts before a space or line end that stands
    between two other characters. Where a text has no other white space, its ids are those of the units between these
    cuts. Each distinct unit of a run of rows is looked up, or encoded once; any other text, and one that holds a special token's literal, is encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # What the library takes for one token wherever it stands in a text: such texts are encoded whole.
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.lengths = np.zeros(self.vocabulary, np.int64)  # bytes of each id: a character of a piece stands for a byte
        for piece, k in vocabulary.items():
            self.lengths[k] = len(piece)
        # Known units by ascending hash, with a second hash, the place of their ids in `ids`, how many these are, and how often they were met.
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begins, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """One text after another: what the library tells of a text besides its ids takes some 100 bytes a token."""
        return [np.array(self.library.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for t in texts]

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, and how many each has. They are encoded as running text; the bytes that ids stand for tell where each unit ends.

        A unit without a gap before it borrows a line end.
        """
        out, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(units), 8192):
            own = units[i : i + 8192]
            bare = np.array([u[0] not in b" \n" for u in own])
            ids = self.whole([b"".join([b"\n" + u if b else u for u, b in zip(own, bare.tolist(), strict=True)]).decode()])[0]
            upto = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + bare)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), upto) + 1
            starts = np.append(0, ends[:-1])
            keep = np.ones(len(ids), bool)
            keep[starts[bare]] = False  # the borrowed line ends
            out.append(ids[keep])
            sizes.append(ends - starts - bare)
        return np.concatenate(out), np.concatenate(sizes)

    def _look_up(self, keys: np.ndarray, checks: np.ndarray, unit) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each unit begin in `self.ids`, and how many they are; unit(k) is the k-th unit's bytes. Keys ascend."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        known = (self.keys[near] == keys) & (self.checks[near] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, sizes = self._encode([unit(k) for k in new.tolist()])
            begins = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, ids])
            place = at[new]
            self.keys, self.checks = np.insert(self.keys, place, keys[new]), np.insert(self.checks, place, checks[new])
            self.begins, self.sizes, self.met = (np.insert(x, place, v) for x, v in ((self.begins, begins), (self.sizes, sizes), (self.met, 0)))
            # Where two units share a key the later one stands first, and is found; the other is only encoded again.
            near = np.searchsorted(self.keys, keys)
        self.met[near] += 1
        return self.begins[near], self.sizes[near]

    def _forget(self) -> None:
        """Keep the units met more than once since the last time, the most met first, as far as half the memory goes in units and in ids."""
        keep = np.flatnonzero(self.met > 1)
        keep = keep[np.argsort(-self.met[keep], kind="stable")[: MEMORY // 2]]
        keep = keep[np.cumsum(self.sizes[keep]) <= 4 * MEMORY]
        keep.sort()
        sizes = self.sizes[keep]
        self.ids = self.ids[np.repeat(self.begins[keep] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        self.keys, self.checks, self.begins, self.sizes, self.met = self.keys[keep], self.checks[keep], np.cumsum(sizes) - sizes, sizes, np.zeros(len(keep), np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's ids end."""
        odd = odd_rows(data, offsets)
        flat = data.tobytes()
        for literal in self.special:
            at = flat.find(literal)
            while at >= 0:  # one that runs over the end of a row is none, but does no harm
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = flat.find(literal, at + len(literal))
        starts, ends, first = word_spans(data, offsets, ~_GAP)
        row = np.repeat(np.arange(len(odd)), np.diff(first))
        plain = ~odd[row]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        opens = starts == offsets[row]
        kind = np.where(opens, 0, data[starts - 1]).astype(np.uint64)  # what stands before: nothing, a space, a line end
        keys, index, place = np.unique(mix64(span_hashes(data, starts, ends) + kind), return_index=True, return_inverse=True)
        since, until = starts[index] - ~opens[index], ends[index]
        checks = (span_hashes(data ^ np.uint8(0x5A), *(x[np.argsort(index)] for x in (since, until)))[np.argsort(np.argsort(index))] >> np.uint64(32)).astype(np.uint32) if len(index) else np.zeros(0, np.uint32)
        if len(self.keys) > MEMORY or len(self.ids) > 8 * MEMORY:
            self._forget()
        begin, size = self._look_up(keys, checks, lambda k: flat[since[k] : until[k]])
        table = self.ids
        each = size[place]
        upto = np.cumsum(each)
        ids = table[np.repeat(begin[place] - upto + each, each) + np.arange(int(upto[-1]) if len(upto) else 0)]
        counts = np.bincount(row, each, len(odd)).astype(np.int64)
        rest = np.flatnonzero(odd)
        if len(rest):
            ids = ids.astype("<u4")
            told = self.whole([flat[offsets[k] : offsets[k + 1]].decode() for k in rest.tolist()])
            at = np.cumsum(counts)
            parts, last = [], 0
            for k, own in zip(rest.tolist(), told, strict=True):
                parts += [ids[last : at[k]], own]
                last = at[k]
                counts[k] = len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, np.cumsum(counts)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(documents: DataFrame, tokenizer: str, end: int, path: str, block: int = 1 << 20, key: str = "doc_id") -> None:
    """Encode every text and write the data set at `path`, a folder that driver and executors share."""
    kind = documents.schema[key].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("bits", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
    ])
    tail = np.array([end], "<u4")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        bits = width(max(encoder.vocabulary, end + 1))
        number, held, keys, ends, total = 0, [], [], [], 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            payload = pack(np.concatenate(held), bits)
            row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([bits], pa.int32()), pa.array([keys], pa.list_(kind)), pa.array([ends], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            last = batch.column(0).type
            for part, data, offsets in cut_rows(batch, "text"):
                ids, upto = encoder(data, offsets)
                names, begin = part.column(0).to_pylist(), 0
                for k, stop in enumerate(upto.tolist()):
                    held += [ids[begin:stop], tail]
                    total += stop - begin + 1
                    begin = stop
                    keys.append(names[k])
                    ends.append(total)
                    if total >= block:
                        yield flush(last)
                        number, held, keys, ends, total = number + 1, [], [], [], 0
        if keys:
            yield flush(last)

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(key, F.col("text")).repartitionByRange(parts, key, F.crc32(F.col("text").cast("binary"))).sortWithinPartitions(key, F.crc32(F.col("text").cast("binary")))
    ordered.mapInArrow(blocks, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a data set, from its files alone.

    The starts come from one total a block: the running sum over blocks orders a row for each million ids or so.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, numbers, widths, doc_ids, ends, payloads = (batch.column(c) for c in ("shard", "block", "bits", "doc_ids", "ends", "payload"))
            for k in range(batch.num_rows):  # a block after another, so that only one is unpacked at a time
                edges = np.append(0, ends[k].values.to_numpy(zero_copy_only=False)).astype(np.int64)
                ids = unpack(payloads[k].as_buffer(), widths[k].as_py(), 0, int(edges[-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                place = [pa.array(np.full(len(crc), x[k].as_py(), np.int32)) for x in (shards, numbers)]
                yield pa.RecordBatch.from_arrays([*place, doc_ids[k].values, pa.array(edges[:-1]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])
            tidy()

    rows = files.select("shard", "block", "bits", "doc_ids", "ends", "payload").mapInArrow(documents, f"shard int, block int, doc_id {kind}, within long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.select("shard", "block", F.element_at("ends", -1).alias("n"))
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))  # one row a partition
    starts = totals.join(shards, "shard").select("shard", "block", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base"))
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(documents: DataFrame, tokenizer: str, end: int, block: int = 1 << 20) -> DataFrame:
    path = new_path(documents.sparkSession, "tokens")
    write(documents, tokenizer, end, path, block)
    return read(documents.sparkSession, path)
