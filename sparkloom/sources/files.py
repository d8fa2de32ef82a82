"""Readers and writers of the plain text and binary formats for sequences, points, triangles, rays and graphs.

Text is split into words where it is read; the place of a word is its place in its piece of a file
plus the counts of all pieces before, so large files are read in parallel and no word is sorted.
Binary formats are decoded from whole files by Arrow Python. Parquet is the native format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.tables import settle

# First lines of the older text formats.
HEADERS = {
    "sequenceInt": "long", "sequenceDouble": "double", "sequenceChar": "string", "sequenceIntPair": "pair", "sequenceStringIntPair": "string pair",
    "pbbs_sequencePoint2d": "point2d", "pbbs_sequencePoint3d": "point3d", "AdjacencyGraph": "graph", "EdgeArray": "edges", "WeightedEdgeArray": "weighted edges", "pbbs_triangles": "triangles",
}
POINTS = {2: "pbbs_sequencePoint2d", 3: "pbbs_sequencePoint3d"}


class WrongHeader(ValueError):
    pass


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value of each line, file and start of the piece that it was read in. Spark deals large pieces first, so its partitions are not in the files' order."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def first_line(spark: SparkSession, path: str) -> str:
    """Of the first file by name; empty if there is none."""
    lines = _lines(spark, path).withColumn("m", F.monotonically_increasing_id())
    return lines.agg(F.min_by("value", F.struct("file", "start", "m")).alias("v")).first()["v"] or ""


def words(spark: SparkSession, path: str) -> DataFrame:
    """i (from 0), word: all words of a text file, or of a folder's files by name, in order."""
    split = _lines(spark, path).select("file", "start", F.explode(F.split("value", r"[ \t\r\n\x00]+")).alias("word")).where("word <> ''")
    rows = settle(split.select("file", "start", F.monotonically_increasing_id().alias("m"), "word"), "words")
    upto = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    pieces = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    pieces = pieces.select("file", "start", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("m0")).alias("shift"))
    return rows.join(F.broadcast(pieces), ["file", "start"]).select((F.col("m") + F.col("shift")).alias("i"), "word")


def _body(all_: DataFrame, header: str | None) -> DataFrame:
    if header is None:
        return all_
    first = all_.where("i = 0").first()
    if first is None or first["word"] != header:
        raise WrongHeader(f"expected {header}, found {first['word'] if first else 'nothing'}")
    return all_.where("i > 0").select((F.col("i") - 1).alias("i"), "word")


def records(all_: DataFrame, width: int, names: list[str], kinds: list[str], idx: str = "idx", start: int = 0, count: int | None = None) -> DataFrame:
    """Runs of `width` words, from word `start` on, as rows."""
    rows = all_.where(F.col("i") >= start)
    if count is not None:
        rows = rows.where(F.col("i") < start + width * count)
    if width == 1:
        return rows.select((F.col("i") - start).alias(idx), F.col("word").cast(kinds[0]).alias(names[0]))
    at = F.floor((F.col("i") - start) / width).cast("long").alias(idx)
    picks = [F.max(F.when(F.pmod(F.col("i") - start, F.lit(width)) == k, F.col("word"))).cast(kind).alias(name) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))]
    return rows.groupBy(at).agg(*picks)


def read_sequence(spark: SparkSession, path: str, kind: str = "long", header: str | None = None) -> DataFrame:
    """idx, v."""
    return records(_body(words(spark, path), header), 1, ["v"], [kind])


def read_pairs(spark: SparkSession, path: str, kinds: tuple[str, str] = ("long", "long"), header: str | None = None) -> DataFrame:
    return records(_body(words(spark, path), header), 2, ["v", "w"], list(kinds))


def read_points(spark: SparkSession, path: str, dims: int = 2, header: bool = True) -> DataFrame:
    """pid, x, y[, z]."""
    return records(_body(words(spark, path), POINTS[dims] if header else None), dims, list("xyz")[:dims], ["double"] * dims, "pid")


def read_triangles(spark: SparkSession, path: str, dims: int = 2, header: str | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """points, tris: counts, then points, then corner ids less `offset`."""
    body = settle(_body(words(spark, path), header), "words")
    n, m = (int(r["word"]) for r in body.where("i < 2").orderBy("i").collect())
    points = records(body, dims, list("xyz")[:dims], ["double"] * dims, "pid", 2, n)
    tris = records(body, 3, list("abc"), ["long"] * 3, "tid", 2 + dims * n, m)
    return points, tris.select("tid", *[(F.col(c) - offset).alias(c) for c in "abc"])


def read_node_ele(spark: SparkSession, nodes: str, elements: str) -> tuple[DataFrame, DataFrame]:
    """points, tris of a .node and an .ele file: four words a record after their heads; ids from 0."""
    p = records(words(spark, nodes), 4, ["id", "x", "y", "mark"], ["long", "double", "double", "long"], "k", 4)
    t = records(words(spark, elements), 4, ["id", "a", "b", "c"], ["long"] * 4, "k", 3)
    base = p.agg(F.min("id").alias("b")).first()["b"] or 0
    return p.select((F.col("id") - base).alias("pid"), "x", "y"), t.select(F.col("k").alias("tid"), *[(F.col(c) - base).alias(c) for c in "abc"])


def read_rays(spark: SparkSession, path: str) -> DataFrame:
    """rid, origin, direction: six numbers a ray."""
    return records(words(spark, path), 6, ["ox", "oy", "oz", "dx", "dy", "dz"], ["double"] * 6, "rid")


def read_graph(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """u, v: counts n and m, n offsets, then m neighbours; a vertex owns the neighbours from its offset to the next one's."""
    body = settle(_body(words(spark, path), header), "words")
    n, m = (int(r["word"]) for r in body.where("i < 2").orderBy("i").collect())
    offsets = records(body, 1, ["at"], ["long"], "u", 2, n)
    following = offsets.select((F.col("u") - 1).alias("u"), F.col("at").alias("until"))
    owned = offsets.join(following, "u", "left").select("u", "at", F.coalesce("until", F.lit(m).cast("long")).alias("until")).where("at < until")
    heads = records(body, 1, ["v"], ["long"], "k", 2 + n, m)
    return owned.select("u", F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("k")).join(heads, "k").select("u", "v")


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """eid, u, v[, weight] after the header."""
    body = _body(words(spark, path), "WeightedEdgeArray" if weighted else "EdgeArray")
    return records(body, 3 if weighted else 2, ["u", "v", "weight"][: 3 if weighted else 2], ["long", "long", "double"][: 3 if weighted else 2], "eid")


def rows_of(edges: DataFrame) -> int:
    """Rows that an edge list implies: its largest id + 1."""
    m = edges.agg(F.max(F.greatest("u", "v")).alias("m")).first()["m"]
    return 0 if m is None else int(m) + 1


def write_words(df: DataFrame, path: str, *columns: str, idx: str = "idx", head: list[str] | None = None) -> None:
    """A folder of text files in order of idx: `head` lines, then a line a row; doubles as %.11e."""
    text = [F.format_string("%.11e", c) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("string") for c in columns]
    rows = df.select(F.col(idx).cast("long").alias("i"), F.concat_ws(" ", *text).alias("value"))
    if head:
        first = df.sparkSession.createDataFrame([(k - len(head), h) for k, h in enumerate(head)], "i long, value string")
        rows = rows.unionByName(first)
    rows.repartitionByRange("i").sortWithinPartitions("i").select("value").write.text(path)


def write_graph(edges: DataFrame, vertices: int, path: str, header: str | None = None) -> None:
    """Adjacency text of (u, v): counts, offsets, neighbours."""
    m = edges.count()
    order = blocks.dense_index(edges.select("u", "v"), "u", "v", name="k")
    from ..operators.sequence import bucket_offsets

    offsets = bucket_offsets(edges, "u", vertices).select(F.col("bucket").alias("idx"), F.col("start").alias("v"))
    write_words(offsets.unionByName(order.select((F.col("k") + vertices).alias("idx"), "v")), path, "v", head=[*([header] if header else []), str(vertices), str(m)])


# --- binary ---------------------------------------------------------------------------------------------

_NUMPY = {"int": "<i4", "long": "<i8", "double": "<f8"}


def _decode(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """Whole binary files, by a function from bytes to columns; each file is one task's work, as the formats have no split points."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                columns = rows(content.as_py())
                names = list(columns)
                n = len(next(iter(columns.values())))
                for i in range(0, max(n, 1), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[k][i : i + (1 << 16)]) for k in names], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(told, schema)


def read_binary_sequence(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """idx, v: an 8-byte count, then little-endian items."""

    def rows(b: bytes) -> dict:
        n = struct.unpack_from("<q", b)[0]
        return {"idx": np.arange(n), "v": np.frombuffer(b, _NUMPY[kind], n, 8)}

    return _decode(spark, path, f"idx long, v {kind}", rows)


class WrongSize(ValueError):
    pass


def _fits(b: bytes, size: int) -> None:
    if size != len(b):
        raise WrongSize(f"the head asks for {size} bytes, the file has {len(b)}")


def read_binary_strings(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """idx, v[, w]: an 8-byte count, all lengths of 4 bytes, then for each item its bytes and, if numbered, a 4-byte integer."""

    def rows(b: bytes) -> dict:
        n = struct.unpack_from("<q", b)[0]
        sizes = np.frombuffer(b, "<i4", n, 8).astype(np.int64)
        ends = 8 + 4 * n + np.cumsum(sizes) + 4 * numbered * np.arange(n)
        _fits(b, int(ends[-1]) + 4 * numbered if n else 8)
        out = {"idx": np.arange(n), "v": pa.array([b[e - k : e].decode() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string())}
        return out | ({"w": np.array([struct.unpack_from("<i", b, e)[0] for e in ends.tolist()], np.int32)} if numbered else {})

    return _decode(spark, path, "idx long, v string" + ", w int" * numbered, rows)


def read_binary_graph(spark: SparkSession, path: str) -> DataFrame:
    """u, v: n and m, n degrees, m neighbours, all of 4 bytes, or all of 8: the file's size tells."""

    def rows(b: bytes) -> dict:
        kind, n, m = "<i4", *struct.unpack_from("<ii", b)
        if len(b) != 4 * (2 + n + m):
            kind, n, m = "<i8", *struct.unpack_from("<qq", b)
            _fits(b, 8 * (2 + n + m))
        flat = np.frombuffer(b, kind).astype(np.int64)
        return {"u": np.repeat(np.arange(n), flat[2 : 2 + n]), "v": flat[2 + n :]}

    return _decode(spark, path, "u long, v long", rows)


def read_adjacency_binary(spark: SparkSession, path: str) -> DataFrame:
    """u, v: five 8-byte header words (n is the third, m the fourth), n + 1 offsets, m neighbours; ids of 4 or 8 bytes, told by the file's size."""

    def rows(b: bytes) -> dict:
        n, m = struct.unpack_from("<5Q", b)[2:4]
        wide = "<u8" if len(b) >= 40 + 8 * (n + 1 + m) else "<u4"
        offsets = np.frombuffer(b, wide, n + 1, 40).astype(np.int64)
        return {"u": np.repeat(np.arange(n), np.diff(offsets)), "v": np.frombuffer(b, wide, m, 40 + (n + 1) * int(wide[-1])).astype(np.int64)}

    return _decode(spark, path, "u long, v long", rows)


def _arrays(b: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays one after another, each an 8-byte count and items of `width` numbers."""
    out, at = [], 0
    for kind, width in kinds:
        n = struct.unpack_from("<q", b, at)[0]
        x = np.frombuffer(b, kind, n * width, at + 8).reshape(n, width)
        at += 8 + x.nbytes
        out.append(x)
    _fits(b, at)
    return out


def _columns(x: np.ndarray, idx: str, names: list[str]) -> dict:
    return {idx: np.arange(len(x))} | {c: np.ascontiguousarray(x[:, k]) for k, c in enumerate(names)}


def _read_arrays(spark: SparkSession, path: str, parts: list[tuple[str, str, list[str]]]) -> list[DataFrame]:
    """parts: kind of the numbers, index column, columns of each array in the file. A table for each."""
    kinds = [(_NUMPY[kind], len(names)) for kind, _, names in parts]
    return [
        _decode(spark, path, f"{idx} long, " + ", ".join(f"{c} {'double' if kind == 'double' else 'long'}" for c in names), lambda b, k=k, idx=idx, names=names, kind=kind: _columns(_arrays(b, *kinds)[k].astype("<f8" if kind == "double" else "<i8"), idx, names))
        for k, (kind, idx, names) in enumerate(parts)
    ]


_CORNERS = ("int", "tid", list("abc"))
_RAYS = ("double", "rid", ["ox", "oy", "oz", "dx", "dy", "dz"])


def read_binary_triangles(spark: SparkSession, path: str, dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """points, tris: a count and doubles of the points, then a count and 4-byte corner ids."""
    return tuple(_read_arrays(spark, path, [("double", "pid", list("xyz")[:dims]), _CORNERS]))


def read_binary_ray_test(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points, tris, rays: three arrays, the rays as origin and direction."""
    return tuple(_read_arrays(spark, path, [("double", "pid", list("xyz")), _CORNERS, _RAYS]))


def _item_bytes(df: DataFrame, columns: tuple[str, ...], idx: str, only: str | None = None) -> DataFrame:
    """m, chunk: the rows in order of idx as little-endian bytes. `only` is 'sizes' or 'rest' for the two parts of strings."""
    kinds = [df.schema[c].dataType.typeName() for c in columns]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only == "sizes":
                out = b"".join(struct.pack("<i", len(x.encode())) for x in batch.column(0).to_pylist())
            elif only == "rest":
                out = b"".join(x.encode() + (b"" if not w else struct.pack("<i", *w)) for x, *w in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            else:
                parts = [(f"c{k}", {"integer": "<i4", "long": "<i8", "double": "<f8"}[kind]) for k, kind in enumerate(kinds)]
                items = np.zeros(batch.num_rows, parts)
                for k, (name, _) in enumerate(parts):
                    items[name] = batch.column(k).to_numpy(zero_copy_only=False)
                out = items.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["chunk"])

    return df.repartitionByRange(idx).sortWithinPartitions(idx).select(*columns).mapInArrow(packed, "chunk binary")


def write_binary(df: DataFrame, path: str, *columns: str, idx: str = "idx") -> None:
    """One file: an 8-byte count, then the items in order of idx; strings, alone or with an integer, as read_binary_strings has them.

    The format has one head, so one stream writes it: chunks come to the driver one partition after another and are never held together.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    passes = ("sizes", "rest") if df.schema[columns[0]].dataType.typeName() == "string" else (None,)
    try:
        out.write(bytearray(struct.pack("<q", df.count())))
        for only in passes:
            for row in _item_bytes(df, columns, idx, only).toLocalIterator():
                out.write(bytearray(row["chunk"]))
    finally:
        out.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file through the session's own file systems: for formats with a single head, made on the driver from bounded data."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def binary_sequence(values: np.ndarray, kind: str) -> bytes:
    return struct.pack("<q", len(values)) + np.asarray(values, _NUMPY[kind]).tobytes()


# --- dispatch -------------------------------------------------------------------------------------------


def _dimensions(body: DataFrame) -> int:
    """Of the points of a triangle file, by its counts and the number of its words."""
    n, m = (int(r["word"]) for r in body.where("i < 2").orderBy("i").collect())
    return (body.count() - 2 - 3 * m) // n if n else 2


def load(spark: SparkSession, path: str, kind: str = "long", second: str | None = None) -> DataFrame | tuple[DataFrame, ...]:
    """By extension: .txt (with or without a known first line), .bin, .adj_bin, else Parquet.

    kind "triangles" gives points and tris; "rays" gives points, tris and rays, as text from two files, of which `second` has the rays.
    """
    if path.endswith(".adj_bin"):
        return read_adjacency_binary(spark, path)
    if path.endswith(".bin"):
        binary = {
            "graph": read_binary_graph, "string": read_binary_strings, "string pair": lambda s, p: read_binary_strings(s, p, True), "triangles": read_binary_triangles, "triangles3d": lambda s, p: read_binary_triangles(s, p, 3),
            "rays": read_binary_ray_test, "point2d": lambda s, p: _read_arrays(s, p, [("double", "pid", list("xy"))])[0], "point3d": lambda s, p: _read_arrays(s, p, [("double", "pid", list("xyz"))])[0],
            "pair": lambda s, p: _read_arrays(s, p, [("int", "idx", ["v", "w"])])[0],
        }
        return binary[kind](spark, path) if kind in binary else read_binary_sequence(spark, path, kind)
    if path.endswith(".txt"):
        header = first_line(spark, path).strip()
        told = HEADERS.get(header)
        if told == "triangles" or kind in ("triangles", "rays") or second is not None:
            head = header if told else None
            shapes = read_triangles(spark, path, 3 if second is not None else _dimensions(settle(_body(words(spark, path), head), "words")), head)
            return shapes if second is None else (*shapes, read_rays(spark, second))
        if told == "graph" or kind == "graph":
            return read_graph(spark, path, header if told else None)
        if told in ("edges", "weighted edges"):
            return read_edges(spark, path, told != "edges")
        if told in ("point2d", "point3d"):
            return read_points(spark, path, int(told[5]))
        if told in ("pair", "string pair"):
            return read_pairs(spark, path, ("long" if told == "pair" else "string", "long"), header)
        return read_sequence(spark, path, told or kind, header if told else None)
    return spark.read.parquet(path)


def write_triangles(points: DataFrame, tris: DataFrame, path: str, header: str | None = None) -> None:
    """Text: counts, points in order of pid, corners in order of tid."""
    axes = [c for c in "xyz" if c in points.columns]
    n, m = points.count(), tris.count()
    lines = points.select(F.col("pid").cast("long").alias("idx"), F.concat_ws(" ", *[F.format_string("%.11e", c) for c in axes]).alias("v"))
    lines = lines.unionByName(tris.select((F.col("tid") + n).cast("long").alias("idx"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "abc"]).alias("v")))
    write_words(lines, path, "v", head=[*([header] if header else []), str(n), str(m)])


def store(df: DataFrame, path: str, *columns: str, idx: str = "idx") -> None:
    """By extension: .txt as words in order of idx, .bin as items in order of idx, else Parquet."""
    if path.endswith(".txt"):
        write_words(df, path, *columns, idx=idx)
    elif path.endswith(".bin"):
        write_binary(df, path, *columns, idx=idx)
    else:
        df.write.parquet(path)


def load_or_make(spark: SparkSession, path: str, make, again: bool = False) -> DataFrame:
    """The table at `path`; made and kept there first if it is missing or asked for again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if again or not there:
        make(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
