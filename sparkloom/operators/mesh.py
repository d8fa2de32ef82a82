"""Delaunay triangulation and its refinement.

Both edit one mesh step by step, each step depending on the last, so each mesh is one task's work: its size is bounded by
that task's memory (some hundred bytes a point). Checks of meshes are plans over tables.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .spatial import topology

RIM = 10  # vertices of the enclosing circle
REACH = 10.0  # its radius, in diagonals of the points' box
MIN_ANGLE = 30.0


class RefineLimit(RuntimeError):
    pass


class Mesh:
    """Triangles with counter-clockwise corners and, for side k from corner k to the next, the triangle beyond it (-1: none)."""

    def __init__(self, x: list[float], y: list[float], rim: list[int]):
        self.x, self.y = x, y
        self.corners: list[tuple[int, int, int] | None] = []
        self.beyond: list[list[int]] = []
        n = len(rim)
        for k in range(1, n - 1):
            self.corners.append((rim[0], rim[k], rim[k + 1]))
            self.beyond.append([k - 2 if k > 1 else -1, -1, k if k < n - 2 else -1])
        self.free: list[int] = []
        self.last = 0
        self.segments = {(rim[k], rim[(k + 1) % n]) for k in range(n)}

    def turn(self, a: int, b: int, px: float, py: float) -> float:
        return (self.x[b] - self.x[a]) * (py - self.y[a]) - (self.y[b] - self.y[a]) * (px - self.x[a])

    def in_circle(self, t: int, px: float, py: float) -> bool:
        (ax, ay), (bx, by), (cx, cy) = ((self.x[v] - px, self.y[v] - py) for v in self.corners[t])
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * c2 - cy * b2) - ay * (bx * c2 - cx * b2) + a2 * (bx * cy - cx * by) > 0

    def locate(self, px: float, py: float) -> tuple[int, int]:
        """The triangle that holds the point and -1; or the last one on the way out and the side left through."""
        t, seen = self.last, 0
        while True:
            c = self.corners[t]
            for k in range(3):
                s = (k + seen) % 3  # turn the order of sides, so a walk cannot circle
                if self.turn(c[s], c[(s + 1) % 3], px, py) < 0:
                    if self.beyond[t][s] < 0:
                        return t, s
                    t = self.beyond[t][s]
                    break
            else:
                self.last = t
                return t, -1
            seen += 1

    def insert(self, v: int, start: int, cut: tuple[int, int] | None = None) -> list[int]:
        """Put vertex v into the mesh, beginning at a triangle whose circle holds it; returns the new triangles. `cut` is the boundary side that v halves."""
        px, py = self.x[v], self.y[v]
        hole, todo, rim = {start}, [start], []
        while todo:
            t = todo.pop()
            c = self.corners[t]
            for k in range(3):
                o = self.beyond[t][k]
                if o in hole:
                    continue
                if o >= 0 and (self.in_circle(o, px, py) or self.turn(c[k], c[(k + 1) % 3], px, py) <= 0):
                    hole.add(o)
                    todo.append(o)
        for t in hole:
            c = self.corners[t]
            for k in range(3):
                if self.beyond[t][k] not in hole:
                    rim.append((c[k], c[(k + 1) % 3], self.beyond[t][k], t))
        for t in hole:
            self.corners[t] = None
            self.free.append(t)
        made, by_start, by_end = [], {}, {}
        for a, b, o, old in rim:
            if o < 0 and ((a, b) == cut or self.turn(a, b, px, py) <= 0):  # v lies on this side of the boundary: it is cut in two
                continue
            if self.free:
                t = self.free.pop()
            else:
                t = len(self.corners)
                self.corners.append(None)
                self.beyond.append([])
            self.corners[t] = (a, b, v)
            self.beyond[t] = [o, -1, -1]
            by_start[a], by_end[b] = t, t
            if o >= 0:
                c = self.corners[o]
                self.beyond[o][next(k for k in range(3) if c[k] == b and c[(k + 1) % 3] == a)] = t
            made.append(t)
        for t in made:
            a, b, _ = self.corners[t]
            self.beyond[t][1] = by_start.get(b, -1)
            self.beyond[t][2] = by_end.get(a, -1)
        self.last = made[0]
        return made

    def alive(self) -> list[int]:
        return [t for t, c in enumerate(self.corners) if c is not None]

    def least_angle(self, t: int) -> float:
        p = [(self.x[v], self.y[v]) for v in self.corners[t]]
        best = 180.0
        for k in range(3):
            a, b, c = p[k], p[(k + 1) % 3], p[(k + 2) % 3]
            u, w = (b[0] - a[0], b[1] - a[1]), (c[0] - a[0], c[1] - a[1])
            s = math.hypot(*u) * math.hypot(*w)
            best = min(best, math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * w[0] + u[1] * w[1]) / s)))) if s else 0.0)
        return best

    def centre(self, t: int) -> tuple[float, float]:
        a, b, c = self.corners[t]
        ux, uy, wx, wy = self.x[b] - self.x[a], self.y[b] - self.y[a], self.x[c] - self.x[a], self.y[c] - self.y[a]
        d = 2 * (ux * wy - uy * wx)
        u2, w2 = ux * ux + uy * uy, wx * wx + wy * wy
        return self.x[a] + (wy * u2 - uy * w2) / d, self.y[a] + (ux * w2 - wx * u2) / d


    def steiner(self, t: int, bound: float) -> tuple[float, float]:
        """The circumcentre, or the nearer point over the shortest side from which that side is seen under the bound: fewer points do then."""
        px, py = self.centre(t)
        c = self.corners[t]
        sides = [(math.hypot(self.x[c[(k + 1) % 3]] - self.x[c[k]], self.y[c[(k + 1) % 3]] - self.y[c[k]]), k) for k in range(3)]
        short, k = min(sides)
        mx, my = (self.x[c[k]] + self.x[c[(k + 1) % 3]]) / 2, (self.y[c[k]] + self.y[c[(k + 1) % 3]]) / 2
        far, near = math.hypot(px - mx, py - my), short / 2 / math.tan(math.radians(bound) / 2) * 0.999
        return (mx + (px - mx) * near / far, my + (py - my) * near / far) if far > near else (px, py)


def triangulate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All coordinates (the points, then RIM vertices around them) and an array of triangles."""
    low, high = np.array([x.min(), y.min()]), np.array([x.max(), y.max()])
    diagonal = float(np.hypot(*(high - low))) or 1.0
    centre = low + (high - low) / 2
    turn = 2 * np.pi * np.arange(RIM) / RIM
    xs = [*x.tolist(), *(centre[0] + REACH * diagonal * np.cos(turn)).tolist()]
    ys = [*y.tolist(), *(centre[1] + REACH * diagonal * np.sin(turn)).tolist()]
    mesh = Mesh(xs, ys, list(range(len(x), len(x) + RIM)))
    # Points in order of a coarse Morton cell, so that each walk is short.
    cell = ((np.stack([x, y], axis=1) - low) / np.maximum(high - low, 1e-300) * 1023).astype(np.int64)
    code = np.zeros(len(x), np.int64)
    for b in range(10):
        code |= (cell[:, 0] >> b & 1) << 2 * b | (cell[:, 1] >> b & 1) << (2 * b + 1)
    for v in np.argsort(code, kind="stable").tolist():
        mesh.insert(v, mesh.locate(xs[v], ys[v])[0])
    return np.array(xs), np.array(ys), np.array([mesh.corners[t] for t in mesh.alive()], np.int64)


def refined(x: np.ndarray, y: np.ndarray, tris: np.ndarray, bound: float = MIN_ANGLE, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """More points until no triangle has an angle below the bound: boundary sides that a vertex sees under more than a right angle are halved; otherwise the
    circumcentre of a skinny triangle is put in, or, where that would crowd a boundary side, that side is halved."""
    mesh = Mesh(x.tolist(), y.tolist(), [0, 1, 2])
    mesh.corners, mesh.beyond = [tuple(t) for t in tris.tolist()], [[-1, -1, -1] for _ in range(len(tris))]
    side = {(c[k], c[(k + 1) % 3]): (t, k) for t, c in enumerate(mesh.corners) for k in range(3)}
    for (a, b), (t, k) in side.items():
        mesh.beyond[t][k] = side.get((b, a), (-1, 0))[0]
    limit = max(20 * len(x), 1000) if limit is None else limit
    added = 0

    def crowded(a: int, b: int, px: float, py: float) -> bool:
        return (mesh.x[a] - px) * (mesh.x[b] - px) + (mesh.y[a] - py) * (mesh.y[b] - py) < 0

    def add(px: float, py: float, start: int, cut: tuple[int, int] | None = None) -> list[int]:
        nonlocal added
        added += 1
        if added > limit:
            raise RefineLimit(f"more than {limit} points would be added")
        mesh.x.append(px)
        mesh.y.append(py)
        return mesh.insert(len(mesh.x) - 1, start, cut)

    def halve(t: int, k: int) -> list[int]:
        c = mesh.corners[t]
        a, b = c[k], c[(k + 1) % 3]
        return add((mesh.x[a] + mesh.x[b]) / 2, (mesh.y[a] + mesh.y[b]) / 2, t, (a, b))

    heap: list[tuple[float, int, tuple[int, int, int]]] = []

    def ask(ts: list[int]) -> None:
        """Triangles with a crowded boundary side come first, then those of the least angles."""
        for t in ts:
            c = mesh.corners[t]
            rim = any(mesh.beyond[t][k] < 0 and crowded(c[k], c[(k + 1) % 3], mesh.x[c[(k + 2) % 3]], mesh.y[c[(k + 2) % 3]]) for k in range(3))
            least = -1.0 if rim else mesh.least_angle(t)
            if least < bound:
                heapq.heappush(heap, (least, t, c))

    ask(mesh.alive())
    while heap:
        least, t, c = heapq.heappop(heap)
        if mesh.corners[t] != c:  # no longer there
            continue
        if least < 0:
            rim = next(k for k in range(3) if mesh.beyond[t][k] < 0 and crowded(c[k], c[(k + 1) % 3], mesh.x[c[(k + 2) % 3]], mesh.y[c[(k + 2) % 3]]))
            ask(halve(t, rim))
            continue
        px, py = mesh.steiner(t, bound)
        mesh.last = t
        at, out = mesh.locate(px, py)
        if out >= 0:
            ask(halve(at, out))
            if mesh.corners[t] == c:
                heapq.heappush(heap, (least, t, c))
            continue
        # Boundary sides that the new point would crowd: those of the hole it would make.
        hole, stack, hit = {at}, [at], None
        while stack and hit is None:
            h = stack.pop()
            hc = mesh.corners[h]
            for k in range(3):
                o = mesh.beyond[h][k]
                if o < 0 and crowded(hc[k], hc[(k + 1) % 3], px, py):
                    hit = (h, k)
                    break
                if o >= 0 and o not in hole and mesh.in_circle(o, px, py):
                    hole.add(o)
                    stack.append(o)
        ask(halve(*hit) if hit else add(px, py, at))
        if mesh.corners[t] == c:
            heapq.heappush(heap, (least, t, c))
    return np.array(mesh.x), np.array(mesh.y), np.array([mesh.corners[t] for t in mesh.alive()], np.int64)


def _one_task(rows: DataFrame, work) -> tuple[DataFrame, DataFrame]:
    """rows -> (points, tris), by `work` on the whole table in one task."""
    from ..plans.tables import settle

    out = settle(rows.withColumn("__g", F.lit(0)).groupBy("__g").applyInArrow(work, "kind int, id long, x double, y double, a long, b long, c long"), "mesh")
    return out.where("kind = 0").select(F.col("id").alias("pid"), "x", "y"), out.where("kind = 1").select(F.col("id").alias("tid"), "a", "b", "c")


def _packed(ids: np.ndarray, x: np.ndarray, y: np.ndarray, tris: np.ndarray) -> pa.Table:
    n, m = len(ids), len(tris)
    corner = ids[tris]
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), "id": pa.array(np.concatenate([ids, np.arange(m)])), "x": pa.array(np.concatenate([x, np.zeros(m)])), "y": pa.array(np.concatenate([y, np.zeros(m)])),
        **{c: pa.array(np.concatenate([np.full(n, -1), corner[:, k]])) for k, c in enumerate("abc")},
    })


def delaunay(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points (pid, x, y; all different) -> points with RIM more, whose ids follow the largest, and 2n + 8 triangles (tid, a, b, c)."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        pid, x, y = (table.column(c).to_numpy() for c in ("pid", "x", "y"))
        xs, ys, tris = triangulate(x, y)
        return _packed(np.concatenate([pid, pid[-1] + 1 + np.arange(RIM)]), xs, ys, tris)

    return _one_task(points.select(F.col("pid").cast("long").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), work)


def refine(points: DataFrame, tris: DataFrame, bound: float = MIN_ANGLE) -> tuple[DataFrame, DataFrame]:
    """A mesh without an angle below the bound; its first points are those given."""

    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        p, t = table.filter(pa.array(kind == 0)).sort_by("id"), table.filter(pa.array(kind == 1))
        ids = p.column("id").to_numpy()
        place = np.searchsorted(ids, np.stack([t.column(c).to_numpy() for c in "abc"], axis=1))
        xs, ys, out = refined(p.column("x").to_numpy(), p.column("y").to_numpy(), place, bound)
        return _packed(np.concatenate([ids, ids[-1] + 1 + np.arange(len(xs) - len(ids))]), xs, ys, out)

    none, zero = F.lit(-1).cast("long"), F.lit(0.0)
    rows = points.select(F.lit(0).alias("kind"), F.col("pid").alias("id"), "x", "y", none.alias("a"), none.alias("b"), none.alias("c"))
    return _one_task(rows.unionByName(tris.select(F.lit(1).alias("kind"), F.col("tid").alias("id"), zero.alias("x"), zero.alias("y"), "a", "b", "c")), work)


def check(points: DataFrame, tris: DataFrame, slack: float = 1e-10) -> DataFrame:
    """One row: bad_sides (a neighbour on the same side), bad_circles (a neighbour's far corner inside the circle, beyond the slack), triangles."""
    corner = lambda n: points.select(F.col("pid").alias(n), F.col("x").alias(n + "x"), F.col("y").alias(n + "y"))
    shapes = tris.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    far = tris.select(F.col("tid").alias("neighbour"), F.col("a").alias("na"), F.col("b").alias("nb"), F.col("c").alias("nc"))
    sides = topology(tris).where("neighbour IS NOT NULL").join(far, "neighbour")
    top = F.when((F.col("na") != F.col("u")) & (F.col("na") != F.col("v")), F.col("na")).when((F.col("nb") != F.col("u")) & (F.col("nb") != F.col("v")), F.col("nb")).otherwise(F.col("nc"))
    met = sides.select("tid", "u", "v", top.alias("d")).join(shapes, "tid").join(corner("d"), "d")
    met = met.join(points.select(F.col("pid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(points.select(F.col("pid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    a, b, c, d, u, v = (g.point(n + "x", n + "y") for n in "abcduv")
    told = met.agg(F.count_if(g.triangle_area(u, v, d) > 0).alias("bad_sides"), F.count_if(g.in_circle_normalised(a, b, c, d) > slack).alias("bad_circles"))
    return told.crossJoin(F.broadcast(tris.agg(F.count("*").alias("triangles"))))
