"""Queries of the geometry expressions, on points made from part keys: whole numbers, so both sides compute the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from .base import Registry, read

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_COORDS = [f"CAST((p_partkey * {k}) % 101 AS DOUBLE) AS {n}" for n, k in zip(("px", "py", "pz", "qx", "qy", "qz", "rx", "ry", "rz", "sx", "sy", "sz"), (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47), strict=True)]
_P = f"(SELECT p_partkey, p_size, {', '.join(_COORDS)} FROM part)"


def _flat() -> list[g.Point]:
    return [g.point(n + "x", n + "y") for n in "pqrs"]


def _solid() -> list[g.Point]:
    return [g.point(n + "x", n + "y", n + "z") for n in "pqrs"]


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", *_COORDS)


@query(f"""SELECT p_partkey, px + qx AS add_x, py - qy AS sub_y, pz * 2.5 AS scale_z, round(px / 4.0, 9) AS div_x, px * qx + py * qy + pz * qz AS dot, px * qy - py * qx AS cross2,
py * qz - pz * qy AS cross_x, pz * qx - px * qz AS cross_y, px * qy - py * qx AS cross_z, round(sqrt(px * px + py * py + pz * pz), 9) AS length, greatest(px, py, pz) AS max_dim FROM {_P}""")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p2, q2, *_), (p3, q3, *_) = _flat(), _solid()
    cross = g.cross3(p3, q3)
    return _corners(spark, sf_dir).select(
        "p_partkey", g.add(p3, q3)[0].alias("add_x"), g.sub(p3, q3)[1].alias("sub_y"), g.scale(p3, 2.5)[2].alias("scale_z"), F.round(g.divide(p3, 4.0)[0], 9).alias("div_x"), g.dot(p3, q3).alias("dot"), g.cross2(p2, q2).alias("cross2"),
        cross[0].alias("cross_x"), cross[1].alias("cross_y"), cross[2].alias("cross_z"), F.round(g.length(p3), 9).alias("length"), g.max_dim(p3).alias("max_dim"))


@query(f"""SELECT p_partkey, least(px, qx) AS low_x, greatest(py, qy) AS high_y, CAST((px > qx) AS INT) + 2 * CAST((py > qy) AS INT) + 4 * CAST((pz > qz) AS INT) AS octant,
CASE WHEN p_size & 1 <> 0 THEN px + 3 ELSE px - 3 END AS moved_x, CASE WHEN p_size & 2 <> 0 THEN py + 3 ELSE py - 3 END AS moved_y,
(px - 20 > qx OR px + 20 < qx OR py - 20 > qy OR py + 20 < qy OR pz - 20 > qz OR pz + 20 < qz) AS outside,
(px >= least(qx, rx) - 1e-7 AND px <= greatest(qx, rx) + 1e-7 AND py >= least(qy, ry) - 1e-7 AND py <= greatest(qy, ry) + 1e-7 AND pz >= least(qz, rz) - 1e-7 AND pz <= greatest(qz, rz) + 1e-7) AS inside,
2 * (abs(qx - rx) * abs(qy - ry) + abs(qy - ry) * abs(qz - rz) + abs(qz - rz) * abs(qx - rx)) AS surface FROM {_P}""")
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p2, *_), (p3, q3, r3, _) = _flat(), _solid()
    low, high = g.min_coords(q3, r3), g.max_coords(q3, r3)
    moved = g.offset_point(p2, F.col("p_size"), F.lit(3.0))
    return _corners(spark, sf_dir).select(
        "p_partkey", g.min_coords(p3, q3)[0].alias("low_x"), g.max_coords(p3, q3)[1].alias("high_y"), g.quadrant(p3, q3).alias("octant"), moved[0].alias("moved_x"), moved[1].alias("moved_y"),
        g.out_of_box(p3, q3, 20.0).alias("outside"), g.in_box(p3, low, high).alias("inside"), g.box_surface(low, high).alias("surface"))


_ANGLE = "acos((({q}x - {p}x) * ({r}x - {p}x) + ({q}y - {p}y) * ({r}y - {p}y)) / (sqrt(({q}x - {p}x) * ({q}x - {p}x) + ({q}y - {p}y) * ({q}y - {p}y)) * sqrt(({r}x - {p}x) * ({r}x - {p}x) + ({r}y - {p}y) * ({r}y - {p}y)))) * 180.0 / 3.14159"
_ANGLES = [_ANGLE.format(p=p, q=q, r=r) for p, q, r in ("pqr", "qrp", "rpq")]
_REAL = "(px <> qx OR py <> qy) AND (qx <> rx OR qy <> ry) AND (px <> rx OR py <> ry) AND (qx - px) * (ry - py) <> (qy - py) * (rx - px)"
_RISE = {n: f"(({n}x - sx) * ({n}x - sx) + ({n}y - sy) * ({n}y - sy))" for n in "pqr"}
_IN = f"""((py - sy) * {_RISE['q']} - {_RISE['p']} * (qy - sy)) * (rx - sx) + ({_RISE['p']} * (qx - sx) - (px - sx) * {_RISE['q']}) * (ry - sy) + ((px - sx) * (qy - sy) - (py - sy) * (qx - sx)) * {_RISE['r']}"""


@query(f"""SELECT p_partkey, area, round(area / (sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) * sqrt((rx - px) * (rx - px) + (ry - py) * (ry - py))), 9) AS area_normalised, area > 0 AS ccw,
({_IN}) > 0 AS in_circle, round(({_ANGLES[0]}), 6) AS angle, ({_ANGLES[0]}) < 30 OR ({_ANGLES[1]}) < 30 OR ({_ANGLES[2]}) < 30 AS skinny,
round(px + ((ry - py) * ((qx - px) * (qx - px) + (qy - py) * (qy - py)) - (qy - py) * ((rx - px) * (rx - px) + (ry - py) * (ry - py))) / (area * 2.0), 6) AS centre_x FROM (SELECT *, (qx - px) * (ry - py) - (qy - py) * (rx - px) AS area FROM {_P}) WHERE {_REAL}""")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p2, q2, r2, s2 = _flat()
    return _corners(spark, sf_dir).where(_REAL).select(
        "p_partkey", g.triangle_area(p2, q2, r2).alias("area"), F.round(g.triangle_area_normalised(p2, q2, r2), 9).alias("area_normalised"), g.counter_clockwise(p2, q2, r2).alias("ccw"),
        g.in_circle(p2, q2, r2, s2).alias("in_circle"), F.round(g.angle(p2, q2, r2), 6).alias("angle"), g.min_angle_check(p2, q2, r2, 30.0).alias("skinny"), F.round(g.circumcentre(p2, q2, r2)[0], 6).alias("centre_x"))


_LONG = " * ".join(f"sqrt(({n}x - sx) * ({n}x - sx) + ({n}y - sy) * ({n}y - sy) + {_RISE[n]} * {_RISE[n]})" for n in "pqr")


@query(f"SELECT p_partkey, round(({_IN}) / ({_LONG}), 9) AS value FROM {_P} WHERE (px, py) <> (sx, sy) AND (qx, qy) <> (sx, sy) AND (rx, ry) <> (sx, sy)")
def in_circle_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corners(spark, sf_dir).where("(px, py) <> (sx, sy) AND (qx, qy) <> (sx, sy) AND (rx, ry) <> (sx, sy)")
    return rows.select("p_partkey", F.round(g.in_circle_normalised(*_flat()), 9).alias("value"))


_E1, _E2 = [f"(q{c} - p{c})" for c in "xyz"], [f"(r{c} - p{c})" for c in "xyz"]


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def hit_sql(o: list[str], d: list[str], e1: list[str], e2: list[str], a: list[str], frm: str, keep: str) -> str:
    """SELECT keep, t: distance of a ray to a triangle, less than 0 behind it, 0 for a miss."""
    s = [f"({x} - {y})" for x, y in zip(o, a, strict=True)]
    p, q = _cross(d, e2), _cross(s, e1)
    inner = f"SELECT {keep}, {_dot(e1, p)} AS det, {_dot(s, p)} AS du, {_dot(d, q)} AS dv, {_dot(e2, q)} AS dt FROM {frm}"
    return f"SELECT {keep}, CASE WHEN abs(det) >= 1e-8 AND du * (1.0 / det) BETWEEN 0 AND 1 AND dv * (1.0 / det) >= 0 AND du * (1.0 / det) + dv * (1.0 / det) <= 1 THEN dt * (1.0 / det) ELSE 0.0 END AS t FROM ({inner}) WHERE det <> 0 UNION ALL SELECT {keep}, 0.0 AS t FROM ({inner}) WHERE det = 0"


@query(f"SELECT p_partkey, round(t, 9) AS t FROM ({hit_sql(['sx', 'sy', '-1.0'], ['0.25', '0.5', '1.0'], _E1, _E2, ['px', 'py', 'pz'], _P, 'p_partkey')})")
def ray_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ray = (F.col("sx"), F.col("sy"), F.lit(-1.0)), (F.lit(0.25), F.lit(0.5), F.lit(1.0))
    return _corners(spark, sf_dir).select("p_partkey", F.round(g.ray_triangle(*ray, *_solid()[:3]), 9).alias("t"))


@query(f"""SELECT p_partkey, CAST(list_sum(list_transform(range(7), lambda b: (((CAST(px AS BIGINT) >> b) & 1) << (2 * b)) | (((CAST(py AS BIGINT) >> b) & 1) << (2 * b + 1)))) AS BIGINT) AS cell2,
CAST(list_sum(list_transform(range(7), lambda b: (((CAST(px AS BIGINT) >> b) & 1) << (3 * b)) | (((CAST(py AS BIGINT) >> b) & 1) << (3 * b + 1)) | (((CAST(pz AS BIGINT) >> b) & 1) << (3 * b + 2)))) AS BIGINT) AS cell3,
CAST(ceil(log2(p_partkey + 1)) AS INT) AS log_up, p_partkey * 2 AS left_child, p_partkey * 2 + 1 AS right_child, p_partkey // 2 AS parent FROM {_P}""")
def cell_and_heap_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p2, *_), (p3, *_) = _flat(), _solid()
    zero2, zero3 = (F.lit(0.0),) * 2, (F.lit(0.0),) * 3
    key = F.col("p_partkey")
    return _corners(spark, sf_dir).select("p_partkey", g.find_block(p2, zero2, 128.0, 7).alias("cell2"), g.find_block(p3, zero3, 128.0, 7).alias("cell3"), g.log2_up(key + 1).alias("log_up"), g.left_child(key).alias("left_child"), g.right_child(key).alias("right_child"), g.parent(key).alias("parent"))
