"""Queries of generators, and of formats: each table is written, read back, and must come back whole."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import new_path
from ..sources import files, generators
from .base import ORDERS, Registry, hash_sql, orders, read, unit_sql

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("SELECT range AS idx, 7 AS v FROM range(50000)")
def generate_all_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.all_same(spark, 50_000, 7)


@query("SELECT range AS idx, (range * 31) % 50000 AS v FROM range(50000)")
def generate_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.permutation(spark, 50_000, 31)


_SEED = generators.Portable(0)
_ROWS = "FROM (SELECT range AS idx FROM range(50000))"
_TURN = {2: [f"cos(2 * pi() * {unit_sql(0, 11, 'idx')})", f"sin(2 * pi() * {unit_sql(0, 11, 'idx')})"]}
_FLAT = f"sqrt(1 - (2 * {unit_sql(0, 12, 'idx')} - 1) * (2 * {unit_sql(0, 12, 'idx')} - 1))"
_TURN[3] = [f"{_FLAT} * {_TURN[2][0]}", f"{_FLAT} * {_TURN[2][1]}", f"2 * {unit_sql(0, 12, 'idx')} - 1"]


def _points_sql(radius: str, axes: list[str]) -> str:
    return f"SELECT idx AS pid, {', '.join(f'round({radius} * ({a}), 9) AS {n}' for a, n in zip(axes, 'xyz', strict=False))} {_ROWS}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SWAPS = f"(SELECT range AS k, {hash_sql(0, 1, 'range')} % 50000 AS a, {hash_sql(0, 2, 'range')} % 50000 AS b FROM range(200))"
_POWER = f"pow(2, floor({unit_sql(0, 1, 'idx')} * 16))"
_CORNERS = [("0", "0", "0"), ("0.01", "0.01", "0"), ("0.01", "0", "0.01")]
_SCENE = " UNION ALL ".join(f"SELECT idx * 3 + {k} AS pid, {', '.join(f'2 * {unit_sql(0, axis, "idx")} - 1 + CAST({d} AS DOUBLE) AS {n}' for axis, (d, n) in enumerate(zip(c, 'xyz', strict=True)))} FROM (SELECT range AS idx FROM range(10000))" for k, c in enumerate(_CORNERS))
_ON_FACE = {c + k: f"low_{c} + (high_{c} - low_{c}) * {unit_sql(1, n, 'rid')}" for n, (c, k) in enumerate((("x", "o"), ("y", "o"), ("x", "e"), ("y", "e")), 1)}

for _name, (_make, _sql) in {
    "generate_ints": (lambda s: generators.random_ints(s, 50_000, _SEED), f"SELECT idx, CAST({hash_sql(0, 'idx')} >> 21 AS INT) AS v {_ROWS}"),
    "generate_doubles": (lambda s: generators.random_doubles(s, 50_000, _SEED), f"SELECT idx, round({unit_sql(0, 'idx')}, 9) AS v {_ROWS}"),
    "generate_bounded": (lambda s: generators.bounded_ints(s, 50_000, 1000, _SEED), f"SELECT idx, {hash_sql(0, 'idx')} % 1000 AS v {_ROWS}"),
    "generate_almost_sorted": (
        lambda s: generators.almost_sorted(s, 50_000, 200, _SEED),
        f"WITH RECURSIVE s AS {_SWAPS}, r AS (SELECT CAST(0 AS BIGINT) AS k, a AS v, a AS place FROM (SELECT a FROM s UNION SELECT b FROM s) UNION ALL SELECT r.k + 1, v, CASE place WHEN a THEN b WHEN b THEN a ELSE place END FROM r JOIN s ON s.k = r.k) "
        f"SELECT place AS idx, v FROM r WHERE k = 200 UNION ALL SELECT idx, idx AS v {_ROWS} WHERE idx NOT IN (SELECT v FROM r)",
    ),
    "generate_exponential": (lambda s: generators.exponential_ints(s, 50_000, _SEED), f"SELECT idx, CAST({hash_sql(0, 'pick')} >> 21 AS INT) AS v FROM (SELECT idx, CAST({_POWER} + floor({unit_sql(0, 2, 'idx')} * {_POWER}) AS BIGINT) AS pick {_ROWS})"),
    "generate_pairs": (lambda s: generators.with_payload(generators.random_ints(s, 50_000, _SEED), 256, _SEED + 7), f"SELECT idx, CAST({hash_sql(0, 'idx')} >> 21 AS INT) AS v, {hash_sql(7, 'idx')} % 256 AS w {_ROWS}"),
    "generate_square": (lambda s: generators.uniform_square(s, 50_000, 2, _SEED), _points_sql("1", [f"2 * {unit_sql(0, k, 'idx')} - 1" for k in range(2)])),
    "generate_cube": (lambda s: generators.uniform_square(s, 50_000, 3, _SEED), _points_sql("1", [f"2 * {unit_sql(0, k, 'idx')} - 1" for k in range(3)])),
    "generate_in_sphere": (lambda s: generators.in_sphere(s, 50_000, 3, _SEED), _points_sql(f"pow({unit_sql(0, 10, 'idx')}, CAST(1 AS DOUBLE) / 3)", _TURN[3])),
    "generate_on_sphere": (lambda s: generators.on_sphere(s, 50_000, 3, _SEED), _points_sql("1", _TURN[3])),
    "generate_kuzmin": (lambda s: generators.kuzmin(s, 50_000, _SEED), _points_sql(f"sqrt(1 / ((1 - {unit_sql(0, 10, 'idx')}) * (1 - {unit_sql(0, 10, 'idx')})) - 1)", _TURN[2])),
    "generate_plummer": (lambda s: generators.plummer(s, 50_000, _SEED), _points_sql("sqrt({0} / (1 - {0}))".format(f"pow({unit_sql(0, 10, 'idx')}, CAST(2 AS DOUBLE) / 3)"), _TURN[3])),
    "generate_rays": (
        lambda s: generators.ray_scene(s, 10_000, _SEED)[2],
        f"WITH b AS (SELECT {', '.join(f'min({c}) AS low_{c}, max({c}) AS high_{c}' for c in 'xyz')} FROM ({_SCENE})), r AS (SELECT range AS rid, {', '.join(f'{v} AS {k[1]}{k[0]}' for k, v in _ON_FACE.items())}, low_z, high_z FROM range(10000), b) "
        "SELECT rid, round(ox, 9) AS ox, round(oy, 9) AS oy, round(low_z, 9) AS oz, round(ex - ox, 9) AS dx, round(ey - oy, 9) AS dy, round(high_z - low_z, 9) AS dz FROM r",
    ),
    "generate_ray_triangles": (lambda s: generators.ray_scene(s, 10_000, _SEED)[0], f"SELECT pid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM ({_SCENE})"),
    "generate_blocks": (
        lambda s: generators.byte_blocks(s, 256, 1000).select("block_id", F.lower(F.hex("data")).alias("data")),
        "SELECT range AS block_id, substr(list_aggregate(list_transform(range(32), lambda k: sha256('0,' || range || ',' || k)), 'string_agg', ''), 1, 2000) AS data FROM range(256)",
    ),
    "generate_nested": (lambda s: generators.nested_rows(s, 300, _SEED), f"SELECT seg, pos, CAST({hash_sql(0, 'seg', 'pos')} % 256 AS INT) AS v FROM (SELECT range AS seg, unnest(range(range)) AS pos FROM range(1, 300))"),
}.items():

    def _made(spark: SparkSession, sf_dir: str, make=_make) -> DataFrame:
        return _rounded(make(spark))

    _made.__name__ = _name
    query(_sql)(_made)


@query(f"SELECT idx, cents AS v FROM {ORDERS}")
def text_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "seq") + ".txt"
    files.write_words(orders(spark, sf_dir), path, "cents", head=["sequenceInt"])
    return files.load(spark, path)


@query("SELECT o_orderkey AS idx, o_totalprice AS v FROM orders")
def text_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "seq") + ".txt"
    files.write_words(orders(spark, sf_dir), path, "price", head=["sequenceDouble"])
    return files.load(spark, path).select("idx", F.round("v", 2).alias("v"))


@query(f"SELECT idx, cust AS v, cents AS w FROM {ORDERS}")
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pairs") + ".txt"
    files.write_words(orders(spark, sf_dir), path, "cust", "cents", head=["sequenceIntPair"])
    return files.load(spark, path)


@query("SELECT c_custkey AS pid, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer WHERE c_custkey IS NOT NULL")
def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "points") + ".txt"
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS idx", "CAST(c_nationkey AS DOUBLE) AS x", "CAST(c_custkey % 97 AS DOUBLE) AS y")
    files.write_words(rows, path, "x", "y", head=["pbbs_sequencePoint2d"])
    first = rows.agg(F.min("idx").alias("m")).first()["m"]
    return files.load(spark, path).select((F.col("pid") + first).alias("pid"), "x", "y")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).distinct()


@query("SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem")
def text_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    path = new_path(spark, "graph") + ".txt"
    files.write_graph(edges, files.rows_of(edges), path, "AdjacencyGraph")
    return files.load(spark, path)


@query("SELECT row_number() OVER (ORDER BY u, v) - 1 AS eid, u, v, CAST((u + v) % 11 AS DOUBLE) AS weight FROM (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem)")
def text_weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import blocks

    rows = blocks.dense_index(_edges(spark, sf_dir), "u", "v").withColumn("weight", ((F.col("u") + F.col("v")) % 11).cast("double"))
    path = new_path(spark, "edges") + ".txt"
    files.write_words(rows, path, "u", "v", "weight", head=["WeightedEdgeArray"])
    return files.load(spark, path)


@query("SELECT s_suppkey AS idx, s_acctbal AS v FROM supplier")
def binary_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single-file format, so it is written on the driver from the suppliers' few values."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_suppkey").toPandas()
    path = new_path(spark, "seq") + ".bin"
    files.write_bytes(spark, path, files.binary_sequence(rows["s_acctbal"].to_numpy(), "double"))
    return files.load(spark, path, "double").select((F.col("idx") + int(rows["s_suppkey"].iloc[0])).alias("idx"), "v")


@query("SELECT n_nationkey AS idx, n_name AS v FROM nation")
def binary_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["n_name"] for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    path = new_path(spark, "names") + ".bin"
    files.write_bytes(spark, path, struct.pack("<q", len(names)) + b"".join(struct.pack("<i", len(n.encode())) for n in names) + "".join(names).encode())
    return files.load(spark, path, "string")


@query("SELECT CAST(n_regionkey AS BIGINT) AS u, CAST(n_nationkey AS BIGINT) AS v FROM nation")
def binary_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under regions, by both binary graph formats; rows that both agree on."""
    rows = read(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").toPandas()
    u, v = rows["n_regionkey"].to_numpy(), rows["n_nationkey"].to_numpy().astype("<i8")
    n = int(max(u.max(), v.max())) + 1
    degree = np.bincount(u, minlength=n).astype("<i8")
    a, b = new_path(spark, "graph") + ".bin", new_path(spark, "graph") + ".adj_bin"
    files.write_bytes(spark, a, struct.pack("<ii", n, len(v)) + degree.astype("<i4").tobytes() + v.astype("<i4").tobytes())
    offsets = np.append(0, np.cumsum(degree)).astype("<u4")
    files.write_bytes(spark, b, struct.pack("<5Q", 0, 0, n, len(v), 0) + offsets.tobytes() + v.astype("<u4").tobytes())
    return files.load(spark, a, "graph").intersect(files.load(spark, b))


@query("SELECT CAST(s_suppkey % 10 AS BIGINT) AS v, count(*) AS n FROM supplier GROUP BY 1")
def generate_or_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "kept")
    make = lambda s: read(s, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("v"))
    files.load_or_make(spark, path, make)
    return files.load_or_make(spark, path, make).groupBy("v").agg(F.count("*").alias("n"))


_MESH = "SELECT p_partkey - m AS pid, CAST((p_partkey * 37) % 101 AS DOUBLE) AS x, CAST((p_partkey * 53) % 103 AS DOUBLE) AS y, CAST((p_partkey * 71) % 107 AS DOUBLE) AS z, n FROM part, (SELECT min(p_partkey) AS m, count(*) AS n FROM part)"
_TRIS = f"SELECT pid AS tid, pid AS a, (pid + 1) % n AS b, (pid + 2) % n AS c FROM ({_MESH})"
_WITH_CORNERS = f"""SELECT t.tid, {", ".join(f"{p}.{c} AS {p}{c}" for p in ("p", "q", "r") for c in "xyz")} FROM ({_TRIS}) t JOIN ({_MESH}) p ON p.pid = t.a JOIN ({_MESH}) q ON q.pid = t.b JOIN ({_MESH}) r ON r.pid = t.c"""


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_MESH).drop("n"), spark.sql(_TRIS)


def _with_corners(points: DataFrame, tris: DataFrame) -> DataFrame:
    at = lambda n, k: points.select(F.col("pid").alias(k), *[F.col(c).alias(n + c) for c in "xyz"])
    return tris.join(at("p", "a"), "a").join(at("q", "b"), "b").join(at("r", "c"), "c").drop("a", "b", "c")


@query(_WITH_CORNERS)
def text_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "mesh") + ".txt"
    files.write_triangles(*_mesh(spark, sf_dir), path, "pbbs_triangles")
    return _with_corners(*files.load(spark, path))


@query("SELECT pid AS rid, x AS ox, y AS oy, z AS oz, y AS dx, z AS dy, x + 1 AS dz FROM (" + _MESH + ")")
def text_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rays of a scene in two files."""
    points, tris = _mesh(spark, sf_dir)
    a, b = new_path(spark, "scene") + ".txt", new_path(spark, "rays") + ".txt"
    files.write_triangles(points, tris, a)
    files.write_words(points.select(F.col("pid").alias("idx"), "x", "y", "z", F.col("y").alias("dx"), F.col("z").alias("dy"), (F.col("x") + 1).alias("dz")), b, "x", "y", "z", "dx", "dy", "dz")
    return files.load(spark, a, "rays", b)[2]


@query("SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS idx, p_retailprice AS v FROM part")
def binary_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store() and load() of a .bin file over all parts."""
    rows, path = read(spark, sf_dir, "part"), new_path(spark, "prices") + ".bin"
    files.store(rows.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("v")), path, "v")
    return files.load(spark, path, "double")


@query("SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS idx, p_name AS v, p_size AS w FROM part")
def binary_numbered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = read(spark, sf_dir, "part"), new_path(spark, "names") + ".bin"
    files.store(rows.select(F.col("p_partkey").alias("idx"), "p_name", F.col("p_size").cast("int").alias("p_size")), path, "p_name", "p_size")
    return files.load(spark, path, "string pair")


@query("SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS pid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
def converted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converter's way: text in, binary out."""
    a, b = new_path(spark, "points") + ".txt", new_path(spark, "points") + ".bin"
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    files.write_words(rows, a, "x", "y", head=["pbbs_sequencePoint2d"])
    files.store(files.load(spark, a), b, "x", "y", idx="pid")
    return files.load(spark, b, "point2d").select("pid", "x", F.round("y", 2).alias("y"))
