"""Queries of the spatial operators, on points made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import forces, mesh, spatial
from ..sources import generators
from .base import Registry, read
from .geometry import hit_sql

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_SUPPLIERS = "SELECT s_suppkey AS pid, CAST((s_suppkey * 7919) % 1009 AS DOUBLE) AS x, CAST((s_suppkey * s_suppkey * 31 + s_suppkey * 17) % 997 AS DOUBLE) AS y FROM supplier"
_CUSTOMERS = "SELECT c_custkey AS pid, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y FROM customer"
_PARTS = "SELECT p_partkey AS pid, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1013 AS DOUBLE) AS y, CAST((p_partkey * 1299709) % 1019 AS DOUBLE) AS z FROM part"


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    body, _, table = sql.removeprefix("SELECT ").partition(" FROM ")
    return read(spark, sf_dir, table).selectExpr(*[x + (" AS " + x if " " not in x else "") for x in _columns(body)])


def _columns(body: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[last:k].strip())
            last = k + 1
    return [*out, body[last:].strip()]


# The corners e in order: clockwise from the leftmost.
_CLOCKWISE = """w AS (SELECT *, first_value(x) OVER lo AS lx, first_value(y) OVER lo AS ly, first_value(x) OVER hi AS hx, first_value(y) OVER hi AS hy FROM e WINDOW lo AS (ORDER BY x, y), hi AS (ORDER BY x DESC, y DESC)),
s AS (SELECT pid, x, y, CASE WHEN (x, y) = (lx, ly) THEN 0 WHEN (x, y) = (hx, hy) THEN 1 WHEN (hx - lx) * (y - ly) - (hy - ly) * (x - lx) > 0 THEN 0 ELSE 1 END AS chain FROM w)
SELECT row_number() OVER (ORDER BY chain, CASE WHEN chain = 0 THEN x ELSE -x END, CASE WHEN chain = 0 THEN y ELSE -y END) - 1 AS place, pid FROM s"""


@query(f"""WITH p AS ({_SUPPLIERS}), q AS (SELECT min(pid) AS pid, x, y FROM p GROUP BY x, y), e AS (SELECT DISTINCT a.pid, a.x, a.y FROM q a JOIN q b ON a.pid <> b.pid
WHERE NOT EXISTS (SELECT 1 FROM q c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (b.x - c.x) + (c.y - a.y) * (b.y - c.y) < 0))),
{_CLOCKWISE}""")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.hull(_made(spark, sf_dir, _SUPPLIERS))


# A corner sees all other points within less than half a turn; points lie on a grid, so that no other angle is nearer to it than 1e-9.
@query(f"""WITH p AS ({_CUSTOMERS}), q AS (SELECT min(pid) AS pid, x, y FROM p GROUP BY x, y), d AS (SELECT a.pid, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS turn FROM q a JOIN q b ON a.pid <> b.pid),
n AS (SELECT pid, x, y, coalesce(lead(turn) OVER (PARTITION BY pid ORDER BY turn), min(turn) OVER (PARTITION BY pid) + 2 * pi()) - turn AS gap FROM d), e AS (SELECT pid, x, y FROM n GROUP BY ALL HAVING max(gap) > pi() + 1e-10),
{_CLOCKWISE}""")
def convex_hull_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.hull(_made(spark, sf_dir, _CUSTOMERS))


def _knn(points: str, k: int, d2: str) -> str:
    return f"WITH p AS ({points}) SELECT pid, rank, other, round(sqrt(d2), 6) AS distance FROM (SELECT a.pid, b.pid AS other, {d2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {d2}, b.pid) AS rank FROM p a JOIN p b ON a.pid <> b.pid) WHERE rank <= {k}"


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(_knn(_CUSTOMERS, 3, _D2))
def nearest_neighbours_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_made(spark, sf_dir, _CUSTOMERS), 3, ["x", "y"]).withColumn("distance", F.round("distance", 6))


@query(_knn(_PARTS, 5, _D2 + " + (a.z - b.z) * (a.z - b.z)"))
def nearest_neighbours_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_made(spark, sf_dir, _PARTS), 5, ["x", "y", "z"]).withColumn("distance", F.round("distance", 6))


@query(_knn(_CUSTOMERS, 1, _D2))
def nearest_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(_made(spark, sf_dir, _CUSTOMERS), 1, ["x", "y"]).withColumn("distance", F.round("distance", 6))


_TRI = "SELECT p_partkey AS tid, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1013 AS DOUBLE) AS y, CAST((p_partkey * 1299709) % 1019 AS DOUBLE) AS z FROM part"
_RAY = "SELECT p_partkey AS rid, CAST((p_partkey * 6007) % 1009 AS DOUBLE) AS ox, CAST((p_partkey * 6011) % 1013 AS DOUBLE) AS oy, CAST(-1 AS DOUBLE) AS oz, CAST((p_partkey * 6029) % 1009 - (p_partkey * 6007) % 1009 AS DOUBLE) AS dx, CAST((p_partkey * 6037) % 1013 - (p_partkey * 6011) % 1013 AS DOUBLE) AS dy, CAST(1040 AS DOUBLE) AS dz FROM part"
_SIDE = "60.0"


@query(f"""WITH t AS ({_TRI}), r AS ({_RAY}), h AS ({hit_sql(['ox', 'oy', 'oz'], ['dx', 'dy', 'dz'], [_SIDE, _SIDE, '0.0'], [_SIDE, '0.0', _SIDE], ['x', 'y', 'z'], 'r, t', 'rid, tid')})
SELECT rid, coalesce(m, -1) AS tid FROM r LEFT JOIN (SELECT rid, arg_min(tid, (t, tid)) AS m FROM h WHERE t > 0 GROUP BY rid) USING (rid)""")
def ray_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _made(spark, sf_dir, _TRI)
    s = float(_SIDE)
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for k, (a, b, c) in enumerate(((0.0, 0.0, 0.0), (s, s, 0.0), (s, 0.0, s)))])).alias("q")
    points = base.select("tid", "x", "y", "z", corners).select((F.col("tid") * 3 + F.col("q.k")).alias("pid"), (F.col("x") + F.col("q.a")).alias("x"), (F.col("y") + F.col("q.b")).alias("y"), (F.col("z") + F.col("q.c")).alias("z"))
    tris = base.select("tid", (F.col("tid") * 3).alias("a"), (F.col("tid") * 3 + 1).alias("b"), (F.col("tid") * 3 + 2).alias("c"))
    return spatial.ray_cast(points, tris, _made(spark, sf_dir, _RAY))


_BODIES = "SELECT c_custkey AS id, CAST((c_custkey * 7919) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1013 AS DOUBLE) AS y, CAST((c_custkey * 1299709) % 1019 AS DOUBLE) AS z, CAST(c_custkey % 7 + 1 AS DOUBLE) * 100 AS mass FROM customer"


@query(f"""WITH p AS ({_BODIES}), d AS (SELECT a.id, a.mass * b.mass AS m, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON a.id <> b.id), w AS (SELECT *, dx * dx + dy * dy + dz * dz AS r2 FROM d)
SELECT id, round(sum(m * dx / (r2 * sqrt(r2))), 6) AS fx, round(sum(m * dy / (r2 * sqrt(r2))), 6) AS fy, round(sum(m * dz / (r2 * sqrt(r2))), 6) AS fz FROM w WHERE r2 > 0 GROUP BY id""")
def direct_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.direct_forces(_made(spark, sf_dir, _BODIES)).select("id", *[F.round(c, 6).alias(c) for c in ("fx", "fy", "fz")])


# A grid of squares, each cut in two, corners counter-clockwise.
_SQUARES = "SELECT p_partkey AS k, (p_partkey // 40) * 41 + p_partkey % 40 AS n FROM part"
_MESH = f"(SELECT k * 2 AS tid, n AS a, n + 1 AS b, n + 41 AS c FROM ({_SQUARES}) UNION ALL SELECT k * 2 + 1, n + 1, n + 42, n + 41 FROM ({_SQUARES}))"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.floor(F.col("p_partkey") / 40) * 41 + F.col("p_partkey") % 40).cast("long").alias("n"))
    return squares.selectExpr("k * 2 AS tid", "n AS a", "n + 1 AS b", "n + 41 AS c").union(squares.selectExpr("k * 2 + 1", "n + 1", "n + 42", "n + 41"))


@query(f"""WITH s AS (SELECT tid, 0 AS side, a AS u, b AS v FROM {_MESH} UNION ALL SELECT tid, 1, b, c FROM {_MESH} UNION ALL SELECT tid, 2, c, a FROM {_MESH})
SELECT s.tid, s.side, s.u, s.v, o.tid AS neighbour FROM s LEFT JOIN s o ON o.u = s.v AND o.v = s.u""")
def mesh_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.topology(_grid(spark, sf_dir))


@query()
def delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.delaunay(_made(spark, sf_dir, _SUPPLIERS).dropDuplicates(["x", "y"]))[1]


@query("SELECT CAST(0 AS BIGINT) AS bad_sides, CAST(0 AS BIGINT) AS bad_circles, 2 * n + 8 AS triangles FROM (SELECT count(*) AS n FROM (SELECT DISTINCT x, y FROM (" + _SUPPLIERS + ")))")
def delaunay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.check(*mesh.delaunay(_made(spark, sf_dir, _SUPPLIERS).dropDuplicates(["x", "y"])))


@query("SELECT CAST(0 AS BIGINT) AS skinny")
def delaunay_refined_skinny(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, tris = mesh.refine(*mesh.delaunay(_made(spark, sf_dir, _SUPPLIERS).dropDuplicates(["x", "y"])))
    return spatial.skinny(points, tris).agg(F.count("*").alias("skinny"))


@query("SELECT tid FROM (SELECT tid, CAST(CASE WHEN tid % 3 = 0 THEN 1 ELSE 20 END AS DOUBLE) AS h FROM (SELECT p_partkey AS tid FROM part)) WHERE h < 10 * tan(30 * 3.14159 / 180)")
def skinny_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles on a base of length 20: flat ones of height 1, steep ones of height 20."""
    base = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("tid"), F.when(F.col("p_partkey") % 3 == 0, 1.0).otherwise(20.0).alias("h"))
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("f")) for k, (x, y) in enumerate(((0.0, 0.0), (20.0, 0.0), (10.0, 1.0)))])).alias("q")
    points = base.select("tid", "h", corner).select((F.col("tid") * 3 + F.col("q.k")).alias("pid"), F.col("q.x").alias("x"), (F.col("q.f") * F.col("h")).alias("y"))
    return spatial.skinny(points, base.select("tid", (F.col("tid") * 3).alias("a"), (F.col("tid") * 3 + 1).alias("b"), (F.col("tid") * 3 + 2).alias("c")))


_LEVELS = 12


def _tree_sql() -> str:
    """Levels by counts of cells; a cell is there if the one above it is split."""
    levels = ["l0 AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS c0, CAST(0 AS BIGINT) AS c1, count(*) AS points FROM p)"]
    for k in range(1, _LEVELS + 1):
        levels.append(f"l{k} AS (SELECT {k} AS level, a.c0, a.c1, a.points FROM (SELECT CAST(floor(x / 16384 * {2**k}) AS BIGINT) AS c0, CAST(floor(y / 16384 * {2**k}) AS BIGINT) AS c1, count(*) AS points FROM p GROUP BY ALL) a JOIN l{k - 1} b ON b.c0 = a.c0 // 2 AND b.c1 = a.c1 // 2 AND b.points > 16)")
    union = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(_LEVELS + 1))
    return f"WITH p AS ({_CUSTOMERS}), {', '.join(levels)} SELECT level, c0, c1, points, points <= 16 OR level = {_LEVELS} AS is_leaf FROM ({union})"


@query(_tree_sql())
def cell_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cell_tree(_made(spark, sf_dir, _CUSTOMERS), ["x", "y"], 0.0, 16384.0, 16, _LEVELS)


def _errors(spark: SparkSession, sf_dir: str, near) -> DataFrame:
    """id, error: relative to the direct sum."""
    bodies = _made(spark, sf_dir, _BODIES)
    both = spatial.direct_forces(bodies).join(near(bodies).toDF("id", "nx", "ny", "nz"), "id")
    d, f = (geometry.sub(geometry.point("fx", "fy", "fz"), geometry.point("nx", "ny", "nz")), geometry.point("fx", "fy", "fz"))
    return both.select("id", (geometry.length(d) / geometry.length(f)).alias("error"))


@query("SELECT count(*) AS n, true AS near FROM customer")
def approximate_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean error below 0.5 % by quadrupoles."""
    return _errors(spark, sf_dir, spatial.approximate_forces).agg(F.count("*").alias("n"), (F.avg("error") < 0.005).alias("near"))


@query("SELECT count(*) AS n, true AS near, true AS all_near FROM customer")
def multipole_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean error below 1e-6, and none above 1e-3, by expansions."""
    return _errors(spark, sf_dir, lambda b: forces.multipole_forces(b, leaf=16)).agg(F.count("*").alias("n"), (F.avg("error") < 1e-6).alias("near"), (F.max("error") < 1e-3).alias("all_near"))


@query()
def multipole_forces_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many bodies in a sphere as there are line items."""
    n = read(spark, sf_dir, "lineitem").count()
    return forces.multipole_forces(generators.particles(generators.in_sphere(spark, n, 3)))
