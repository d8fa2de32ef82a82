"""Operators over sets of points, triangles and rays.

Neighbour and hit searches deal points and triangles to grid cells and join on
cells; the hull works by segments; tiles of points meet in blocks for forces. Ties go to the lowest id everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans import blocks
from ..plans.tables import dealt, settle, spread

# --- convex hull ------------------------------------------------------------------------------------


def _local_hull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corners of the hull of one partition's points (pid, x, y), batch by batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        pid, x, y = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((pid, y, x)).tolist()
        keep: list[int] = []
        for way in (order, order[::-1]):
            chain: list[int] = []
            for k in way:
                if chain and x[chain[-1]] == x[k] and y[chain[-1]] == y[k]:
                    if pid[k] < pid[chain[-1]]:
                        chain[-1] = k
                    continue
                while len(chain) > 1 and (x[chain[-1]] - x[chain[-2]]) * (y[k] - y[chain[-2]]) - (y[chain[-1]] - y[chain[-2]]) * (x[k] - x[chain[-2]]) <= 0:
                    chain.pop()
                chain.append(k)
            keep += chain
        held = table.take(pa.array(sorted(set(keep)), pa.int64()))
    if held is not None:
        yield from held.combine_chunks().to_batches()


def hull(points: DataFrame) -> DataFrame:
    """points: pid, x, y. Returns place (from 0), pid: corners clockwise from the leftmost (then lowest) point, without points between corners.

    Partitions keep their own hulls' corners; then, by rounds, each open segment takes the point farthest outside
    it and is split there, all segments in one plan. Nothing gathers the points.
    """
    kind = points.schema["pid"].dataType.simpleString()
    pts = settle(points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(_local_hull, f"pid {kind}, x double, y double"), "hull")
    first = pts.agg(F.min(F.struct("x", "y", "pid")).alias("a"), F.max(F.struct("x", "y", (-F.col("pid")).alias("n"))).alias("b")).first()
    if first["a"] is None:
        return points.sparkSession.createDataFrame([], f"place long, pid {kind}")
    a, b = first["a"], first["b"]
    spark = points.sparkSession
    if (a["x"], a["y"]) == (b["x"], b["y"]):
        return spark.createDataFrame([(0, a["pid"])], f"place long, pid {kind}")
    # Segments: chain 0 is the upper one, left to right; chain 1 the lower one, right to left. A point is outside if it lies to the left.
    ax, ay, bx, by = (F.lit(v) for v in (a["x"], a["y"], b["x"], b["y"]))
    side = (bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax)
    open_ = pts.withColumn("side", side).where("side <> 0").select("pid", "x", "y", F.when(F.col("side") > 0, 0).otherwise(1).alias("chain"))
    up = F.col("chain") == 0
    open_ = open_.select("*", F.when(up, ax).otherwise(bx).alias("px"), F.when(up, ay).otherwise(by).alias("py"), F.when(up, bx).otherwise(ax).alias("qx"), F.when(up, by).otherwise(ay).alias("qy"))
    open_ = settle(open_, "hull")
    corners = spark.createDataFrame([(a["pid"], a["x"], a["y"], 0), (-b["n"], b["x"], b["y"], 1)], f"pid {kind}, x double, y double, chain int")
    segment = ["chain", "px", "py", "qx", "qy"]
    while not open_.isEmpty():
        area = (F.col("qx") - F.col("px")) * (F.col("y") - F.col("py")) - (F.col("qy") - F.col("py")) * (F.col("x") - F.col("px"))
        far = open_.groupBy(*segment).agg(F.max(F.struct(area.alias("area"), (-F.col("x")).alias("nx"), (-F.col("y")).alias("ny"), (-F.col("pid")).alias("np"))).alias("m"))
        far = settle(far.select(*segment, (-F.col("m.nx")).alias("mx"), (-F.col("m.ny")).alias("my"), (-F.col("m.np")).alias("mp")), "hull")
        corners = corners.union(far.select("mp", "mx", "my", "chain"))
        asked = open_.join(far, segment)
        left = (F.col("mx") - F.col("px")) * (F.col("y") - F.col("py")) - (F.col("my") - F.col("py")) * (F.col("x") - F.col("px")) > 0
        right = (F.col("qx") - F.col("mx")) * (F.col("y") - F.col("my")) - (F.col("qy") - F.col("my")) * (F.col("x") - F.col("mx")) > 0
        split = asked.select("pid", "x", "y", "chain", *[F.when(left, F.col(u)).otherwise(F.col(v)).alias(n) for n, u, v in (("px", "px", "mx"), ("py", "py", "my"), ("qx", "mx", "qx"), ("qy", "my", "qy"))], (left | right).alias("out")).where("out").drop("out")
        open_ = settle(split, "hull")
    way = F.when(F.col("chain") == 0, F.col("x")).otherwise(-F.col("x"))
    order = corners.distinct().select("pid", "chain", way.alias("way"), F.when(F.col("chain") == 0, F.col("y")).otherwise(-F.col("y")).alias("level"))
    return blocks.dense_index(order, "chain", "way", "level", "pid", name="place").select("place", "pid")


# --- nearest neighbours -------------------------------------------------------------------------------


def _packed(tiles: list[str], d: int, most: int):
    """Rows (tile, id, place) in order of tiles as rows of up to `most` points of one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(d)], axis=1)
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1)))
            cuts = np.concatenate([np.arange(i, j, most) for i, j in zip(starts, np.append(starts[1:], len(at)), strict=True)])
            ends = pa.array(np.append(cuts, len(at)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, batch.column(k)) for k in range(d, 2 * d + 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(at[cuts, k]) for k in range(d)), *lists], names=[*tiles, "ids", *(f"x{i}" for i in range(d))])

    return run


def _nearest_of_packs(d: int, k: int):
    """p, other, d2 of the k nearest of each row's second pack for each point of its first; ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (ids, *at), (others, *places) = ([batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(side, side + d + 1)] for side in (0, d + 1))
                some = max(1, (1 << 17) // len(others))  # points at once, so that their distances stay a MB
                out: list[tuple] = []
                for i in range(0, len(ids), some):
                    own = slice(i, i + some)
                    d2 = (at[0][own, None] - places[0]) ** 2
                    for x, y in zip(at[1:], places[1:], strict=True):
                        d2 += (x[own, None] - y) ** 2
                    d2[ids[own, None] == others] = np.inf
                    most = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(others) > k else np.full(len(d2), np.inf)
                    row, col = np.nonzero((d2 <= most[:, None]) & (d2 < np.inf))
                    order = np.lexsort((others[col], d2[row, col], row))
                    row, col = row[order], col[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    out.append((ids[own][row[kept]], others[col[kept]], d2[row[kept], col[kept]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["p", "other", "d2"])

    return run


def nearest(points: DataFrame, k: int, axes: list[str], key: str = "pid", per_cell: float = 2.0) -> DataFrame:
    """key (an integer), rank (from 1), other, distance: each point's k nearest others, nearest first, ties to the smaller id; coincident points count.

    Points are dealt to square tiles of some hundred, and also to the tiles within a reach of r cells, where a cell has about per_cell * k points. Packs of
    a tile's own points meet packs of all its points, and only the k nearest of each meeting are kept. A point is settled once its k-th distance is
    within the reach; the others look twice as far in the next round. Packs, and so the rows of a task, do not grow with the table or a crowded tile.
    """
    d, kind = len(axes), points.schema[key].dataType.simpleString()
    pts = settle(points.select(F.col(key).alias("p"), *[F.col(a).cast("double").alias(f"x{i}") for i, a in enumerate(axes)]), "points")
    xs = [f"x{i}" for i in range(d)]
    box = pts.agg(F.count("*").alias("n"), *[f(x).alias(f"{m}{x}") for x in xs for m, f in (("a", F.min), ("b", F.max))]).first()
    if not box["n"]:
        return points.select(F.col(key), F.lit(0).alias("rank"), F.col(key).alias("other"), F.lit(0.0).alias("distance")).limit(0)
    spans = [max(box[f"b{x}"] - box[f"a{x}"], 0.0) for x in xs]
    wide = [s for s in spans if s > 0]
    size = (math.prod(wide) * per_cell * k / box["n"]) ** (1 / len(wide)) if wide else 1.0
    size = max(size, max(spans, default=0.0) / 2**30 or 1.0)
    far = int(max(spans) / size) + 2
    tiles = [f"t{i}" for i in range(d)]
    best = Window.partitionBy("p").orderBy("d2", "other")
    pack = lambda df, rows, most: dealt(df.select(*tiles, "p", *xs), rows, *tiles).sortWithinPartitions(*tiles).mapInArrow(_packed(tiles, d, most), f"{', '.join(f'{t} long' for t in tiles)}, ids array<{kind}>, {', '.join(f'{x} array<double>' for x in xs)}")
    open_, r, found = pts, 1, None
    while True:
        edge, reach, n = size * max(round((512 / (per_cell * k)) ** (1 / d)), r), r * size * (1 + 1e-9), open_.count()
        own = open_.select("p", *xs, *[F.floor(F.col(x) / edge).cast("long").alias(t) for x, t in zip(xs, tiles, strict=True)])
        around = pts
        for x, t in zip(xs, tiles, strict=True):
            around = around.withColumn(t, F.explode(F.sequence(F.floor((F.col(x) - reach) / edge), F.floor((F.col(x) + reach) / edge))))
        if open_ is not pts:
            around = around.join(spread(own.select(*tiles).distinct()), tiles, "left_semi")
        theirs = pack(around, int(box["n"] * (1 + 2 * reach / edge) ** d), 4096).withColumnRenamed("ids", "others")
        theirs = theirs.select(*tiles, "others", *[F.col(x).alias("o" + x) for x in xs])
        met = pack(own, n, 1024).join(spread(theirs), tiles).select("ids", *xs, "others", *["o" + x for x in xs])
        near = dealt(met.mapInArrow(_nearest_of_packs(d, k), f"p {kind}, other {kind}, d2 double"), 2 * k * n, "p")
        top = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        top = settle(top.select("p", "other", "d2", "rank"), "nearest")
        if r >= far:
            found = top if found is None else found.unionByName(top)
            break
        done = top.groupBy("p").agg(F.count("*").alias("n"), F.max("d2").alias("m")).where((F.col("n") == k) & (F.sqrt("m") <= r * size)).select("p")
        sure = top.join(done, "p", "left_semi")
        found = sure if found is None else found.unionByName(sure)
        open_ = settle(open_.join(done, "p", "left_anti"), "nearest")
        if open_.isEmpty():
            break
        r = min(2 * r, far)
    return found.select(F.col("p").alias(key), "rank", "other", F.sqrt("d2").alias("distance"))


# --- ray casting ----------------------------------------------------------------------------------------


# Stretches of a ray's way that each round looks at: few at first, as most rays end early, then more, then all that are left.
STRETCHES = ((0, 1), (1, 4), (4, 16), (16, 1 << 30))


def ray_cast(points: DataFrame, tris: DataFrame, rays: DataFrame, grid: int | None = None) -> DataFrame:
    """rid, tid of the triangle that each ray meets first, -1 for none.

    points: pid, x, y, z; tris: tid, a, b, c; rays: rid, ox, oy, oz, dx, dy, dz. Triangles are dealt, with their corners, to the cells of a grid over
    their box that has at most as many cells as there are triangles, none much narrower than half a triangle. A ray's way is cut into stretches of one cell each, numbered from its origin;
    a few rounds join them with the cells in that order, and a ray whose hit lies within the stretches seen so far is done.
    """
    corner = lambda n: spread(points.select(F.col("pid").alias(n), *[F.col(c).cast("double").alias(n + c) for c in "xyz"]))
    shapes = settle(tris.select(F.col("tid").cast("long").alias("tid"), "a", "b", "c").join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c").drop("a", "b", "c"), "triangles")
    lows = {c: F.least(*[F.col(n + c) for n in "abc"]) for c in "xyz"}
    highs = {c: F.greatest(*[F.col(n + c) for n in "abc"]) for c in "xyz"}
    wide = F.avg(F.greatest(*[highs[c] - lows[c] for c in "xyz"])).alias("wide")
    box = shapes.agg(F.count("*").alias("n"), *[F.min(lows[c]).alias("lo" + c) for c in "xyz"], *[F.max(highs[c]).alias("hi" + c) for c in "xyz"], wide).first()
    if box["lox"] is None:
        return rays.select("rid", F.lit(-1).cast("long").alias("tid"))
    across = max(box["hi" + c] - box["lo" + c] for c in "xyz") / max(box["wide"] / 2, 1e-300)  # so that a triangle is in some 27 cells at most, as a rule, however dense they lie
    grid = grid or max(1, round(min(1024, box["n"] ** (1 / 3), across)))
    lo = np.array([box["lo" + c] for c in "xyz"]) - 1e-6
    step = np.maximum((np.array([box["hi" + c] for c in "xyz"]) + 1e-6 - lo) / grid, 1e-9)
    cells = shapes
    for k, c in enumerate("xyz"):
        first, last = (F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((v - float(lo[k])) / float(step[k]) + wide))).cast("int") for v, wide in ((lows[c], -1e-7), (highs[c], 1e-7)))  # a triangle at a plane is in the cells of both sides
        cells = cells.withColumn("cell_" + c, F.explode(F.sequence(first, last)))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0)
            o = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            d = np.stack([batch.column(4 + k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            flat = np.abs(d) < 1e-300
            with np.errstate(all="ignore"):
                t0, t1 = (lo - o) / d, (lo + grid * step - o) / d
            inside = (o >= lo) & (o <= lo + grid * step)
            near, away = np.where(flat, np.where(inside, -np.inf, np.inf), np.minimum(t0, t1)), np.where(flat, np.where(inside, np.inf, -np.inf), np.maximum(t0, t1))
            enter, leave = np.maximum(near.max(axis=1), 0.0), away.min(axis=1)
            met = np.flatnonzero(enter <= leave)
            some = max(1, (1 << 18) // (3 * grid + 5))  # rays at once, so that their crossings stay a few MB
            for k in (met[i : i + some] for i in range(0, len(met), some)):
                # Crossings of grid planes cut the way into stretches of one cell each; those outside the way are put at its end.
                with np.errstate(all="ignore"):
                    t = ((lo + step * np.arange(grid + 1)[:, None] - o[k][:, None, :]) / d[k][:, None, :]).reshape(len(k), -1)
                start, end = enter[k][:, None], leave[k][:, None]
                t = np.sort(np.hstack([start, np.where((t > start) & (t < end), t, end), end]), axis=1)
                long = np.diff(t, axis=1) > 0
                long[:, 0] = True
                row, col = np.nonzero(long)
                middle = (t[row, col] + t[row, col + 1]) / 2
                cell = np.clip(np.floor((o[k][row] + middle[:, None] * d[k][row] - lo) / step), 0, grid - 1).astype(np.int32)
                number = (np.cumsum(long, axis=1) - 1)[row, col].astype(np.int32)
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(k[row])), pa.array(number), *(pa.array(np.ascontiguousarray(cell[:, c])) for c in range(3)), pa.array(t[row, col + 1])], names=["rid", "number", "cell_x", "cell_y", "cell_z", "until"])

    kind = rays.schema["rid"].dataType.simpleString()
    lines = rays.select("rid", *[F.col(c).cast("double").alias(c) for c in ("ox", "oy", "oz", "dx", "dy", "dz")])
    lines = lines.repartition(int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")  # small rows, much work
    ways = settle(lines.mapInArrow(walked, f"rid {kind}, number int, cell_x int, cell_y int, cell_z int, until double"), "ray-ways")
    cells = spread(settle(cells, "triangle-cells"))
    t = g.ray_triangle(g.point("ox", "oy", "oz"), g.point("dx", "dy", "dz"), *(g.point(*(n + c for c in "xyz")) for n in "abc"))
    open_ = lines.withColumn("best", F.lit(None).cast("struct<t:double,tid:bigint>"))
    told: DataFrame | None = None
    for first, end in STRETCHES:
        part = spread(ways.where((F.col("number") >= first) & (F.col("number") < end)))
        hits = part.join(open_, "rid").join(cells, ["cell_x", "cell_y", "cell_z"]).select("rid", F.struct(t.alias("t"), "tid").alias("x")).where("x.t > 0").groupBy("rid").agg(F.min("x").alias("x"))
        seen = part.groupBy("rid").agg(F.max("until").alias("seen"), F.max("number").alias("last"))
        now = open_.join(hits, "rid", "left").join(seen, "rid", "left").withColumn("best", F.least("best", "x"))
        # Done: the hit lies in what was seen, or the way ends there. Ends of stretches are rounded, so a hit at one waits for the next round.
        done = F.coalesce(F.col("last") < end - 1, F.lit(True)) | F.coalesce(F.col("best.t") < F.col("seen") * (1 - 1e-9), F.lit(False))
        now = settle(now.withColumn("done", done).drop("x", "seen", "last"), "ray-round")
        some = now.where("done").select("rid", "best")
        told = some if told is None else told.unionByName(some)
        open_ = now.where("NOT done").drop("done")
    return told.select("rid", F.coalesce("best.tid", F.lit(-1).cast("long")).alias("tid"))


# --- forces ---------------------------------------------------------------------------------------------


def direct_forces(particles: DataFrame, tile: int = 4096) -> DataFrame:
    """particles: id, x, y, z, mass. id, fx, fy, fz: the sum over all others of m_i m_j (p_j - p_i) / |r|^3; coincident pairs give none.

    Tiles of particles meet each other once; a pair of tiles is one numpy product, and only sums leave it. Tiles have at most `tile` particles, and fewer
    where that would leave partitions without one.
    """
    groups = int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = max(64, min(tile, -(-particles.count() // (4 * groups))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, tile):
                own = batch.slice(i, tile)
                ids = own.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data = np.stack([own.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["tile", "ids", "data"])
                number += 1

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, other in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                p, q = np.frombuffer(data).reshape(-1, 4), np.frombuffer(other).reshape(-1, 4)
                out = np.empty((len(p), 3))
                (qx, qy, qz, mass), rows = np.ascontiguousarray(q.T), max(1, (1 << 17) // len(q))  # so that each product stays in the cache
                for i in range(0, len(p), rows):
                    own = p[i : i + rows]
                    x, y, z = qx - own[:, 0, None], qy - own[:, 1, None], qz - own[:, 2, None]
                    d2 = x * x + y * y + z * z
                    with np.errstate(all="ignore"):
                        w = mass * own[:, 3, None] / (d2 * np.sqrt(d2))
                    w[d2 == 0] = 0.0
                    out[i : i + rows] = np.stack([np.einsum("ij,ij->i", w, v) for v in (x, y, z)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(3))], names=["id", "fx", "fy", "fz"])

    tiles = settle(particles.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "mass")]).mapInArrow(packed, "tile long, ids binary, data binary"), "tiles")
    left = tiles.select("ids", "data", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = tiles.select(F.col("data").alias("other"), F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("part"))
    met = left.join(right, "part").select("ids", "data", "other").mapInArrow(pull, "id long, fx double, fy double, fz double")
    return met.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "fz")])


# --- triangle meshes ------------------------------------------------------------------------------------


def topology(tris: DataFrame) -> DataFrame:
    """tid, side (0, 1, 2 from corner a), u, v, neighbour: the triangle across each side, null at the boundary."""
    sides = tris.select("tid", F.posexplode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("side", "e")).select("tid", "side", "e.u", "e.v")
    other = sides.select(F.col("tid").alias("neighbour"), F.col("v").alias("u"), F.col("u").alias("v"))
    rows = 6 * tris.count()
    return dealt(sides, rows, "u", "v").join(dealt(spread(other), rows, "u", "v"), ["u", "v"], "left").select("tid", "side", "u", "v", "neighbour")


def skinny(points: DataFrame, tris: DataFrame, bound: float = 30.0) -> DataFrame:
    """tid of triangles with an angle below the bound."""
    corner = lambda n: spread(points.select(F.col("pid").alias(n), F.col("x").alias(n + "x"), F.col("y").alias(n + "y")))
    shapes = tris.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    return shapes.where(g.min_angle_check(*(g.point(n + "x", n + "y") for n in "abc"), bound)).select("tid")


# --- cell trees -----------------------------------------------------------------------------------------


def cell_tree(points: DataFrame, axes: list[str], low: float, size: float, leaf: int = 16, deepest: int = 20) -> DataFrame:
    """level, one cell number an axis (c0, c1, ...), points, is_leaf: the quad- or octree over the cube [low, low + size) an axis.

    A cell with more than `leaf` points is split in halves along each axis, down to `deepest` levels. Each level is one plan over the points still in open cells.
    """
    pts = settle(points.select(*[((F.col(a).cast("double") - low) / size).alias(f"x{i}") for i, a in enumerate(axes)]), "tree-points")
    cells, tree = [f"c{i}" for i in range(len(axes))], None
    open_ = pts.select("*", *[F.lit(0).cast("long").alias(c) for c in cells])
    for level in range(deepest + 1):
        counts = open_.groupBy(*cells).agg(F.count("*").alias("points")).withColumn("is_leaf", (F.col("points") <= leaf) | F.lit(level == deepest))
        counts = settle(counts.select(F.lit(level).alias("level"), *cells, "points", "is_leaf"), "tree-level")
        tree = counts if tree is None else tree.unionByName(counts)
        split = counts.where("NOT is_leaf").select(*cells)
        if split.isEmpty():
            break
        n = 1 << (level + 1)
        inside = open_.join(split, cells, "left_semi").drop(*cells)
        open_ = inside.select("*", *[F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(f"x{i}") * n))).cast("long").alias(c) for i, c in enumerate(cells)])
        if level % 4 == 3:
            open_ = settle(open_, "tree-points")
    return tree


def tree_depth(tree: DataFrame) -> DataFrame:
    return tree.agg(F.max("level").alias("depth"), F.sum(F.when(F.col("is_leaf"), F.col("points"))).alias("points"), F.count_if(F.col("is_leaf")).alias("leaves"))


# --- forces by cells --------------------------------------------------------------------------------------

_MOMENTS = ["m", "mx", "my", "mz", "xx", "yy", "zz", "xy", "xz", "yz"]


def cell_moments(particles: DataFrame, cells: list[str]) -> DataFrame:
    """Mass, first and second moments of the particles of each cell."""
    x, y, z, m = (F.col(c) for c in ("x", "y", "z", "mass"))
    terms = dict(zip(_MOMENTS, (m, m * x, m * y, m * z, m * x * x, m * y * y, m * z * z, m * x * y, m * x * z, m * y * z), strict=True))
    return particles.groupBy(*cells).agg(*[F.sum(t).alias(n) for n, t in terms.items()])


def merge_moments(moments: DataFrame, cells: list[str]) -> DataFrame:
    """Moments of the cells one level up: sums, as all moments are about one origin."""
    return moments.groupBy(*[F.shiftright(c, 1).alias(c) for c in cells]).agg(*[F.sum(n).alias(n) for n in _MOMENTS])


def cell_pull(p: g.Point) -> g.Point:
    """Field at p of a cell's mass and quadrupole about its centre of mass (columns of cell_moments)."""
    m = F.col("m")
    com = tuple(F.col(c) / m for c in ("mx", "my", "mz"))
    s = {a + b: F.col(a + b) - F.col("m" + a) * F.col("m" + b) / m for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))}
    trace = s["xx"] + s["yy"] + s["zz"]
    q = {k: 3 * v - (trace if k[0] == k[1] else 0) for k, v in s.items()}
    d = g.sub(com, p)
    r2 = g.dot(d, d)
    r = F.sqrt(r2)
    qd = (q["xx"] * d[0] + q["xy"] * d[1] + q["xz"] * d[2], q["xy"] * d[0] + q["yy"] * d[1] + q["yz"] * d[2], q["xz"] * d[0] + q["yz"] * d[1] + q["zz"] * d[2])
    along = m / (r2 * r) + 2.5 * g.dot(d, qd) / (r2 * r2 * r2 * r)
    return tuple(along * x - y / (r2 * r2 * r) for x, y in zip(d, qd, strict=True))


def well_separated(target: list[Column], source: list[Column]) -> Column:
    """Cells of one level that do not touch while their parents do: they meet at this level and at no other."""
    apart, parents = F.lit(False), F.lit(True)
    for t, s in zip(target, source, strict=True):
        apart = apart | (F.abs(t - s) > 1)
        parents = parents & (F.abs(F.shiftright(t, 1) - F.shiftright(s, 1)) <= 1)
    return apart & parents


def approximate_forces(particles: DataFrame, levels: int | None = None, per_leaf: int = 32) -> DataFrame:
    """As direct_forces, with far particles taken together by cells of a grid at each level: work grows as n log n.

    Particles in touching cells of the finest level meet directly; all others through the quadrupoles of well-separated cells.
    """
    p = particles.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "mass")])
    box = p.agg(F.count("*").alias("n"), *[f(c).alias(m + c) for c in "xyz" for m, f in (("a", F.min), ("b", F.max))]).first()
    if not box["n"]:
        return p.select("id", *[F.lit(0.0).alias(c) for c in ("fx", "fy", "fz")])
    size = max(box["b" + c] - box["a" + c] for c in "xyz") * (1 + 1e-9) or 1.0
    levels = max(2, math.ceil(math.log(max(box["n"] / per_leaf, 1), 8))) if levels is None else levels
    cells = ["c0", "c1", "c2"]
    top = (1 << levels) - 1
    at = [F.least(F.lit(top), F.floor((F.col(c) - box["a" + c]) / size * (1 << levels))).cast("long").alias(k) for c, k in zip("xyz", cells, strict=True)]
    p = settle(p.select("*", *at), "bodies")
    moments, far = cell_moments(p, cells), None
    for level in range(levels, 1, -1):
        moments = settle(moments, "moments")
        source = [F.col(c) + F.col("o" + c) for c in cells]
        asked = moments.select(*cells)
        for c in cells:
            asked = asked.withColumn("o" + c, F.explode(F.sequence(F.lit(-3), F.lit(3))))
        asked = asked.where(well_separated([F.col(c) for c in cells], source)).select(*[F.col(c).alias("t" + c) for c in cells], *[s.alias(c) for s, c in zip(source, cells, strict=True)])
        own = spread(p).select("id", "x", "y", "z", "mass", *[F.shiftright(c, levels - level).alias("t" + c) for c in cells])
        met = spread(asked).join(moments, cells).drop(*cells).join(own, ["t" + c for c in cells])
        pull = met.groupBy("id").agg(*[F.sum(f * F.col("mass")).alias(n) for f, n in zip(cell_pull(g.point("x", "y", "z")), ("fx", "fy", "fz"), strict=True)])
        far = pull if far is None else far.unionByName(pull)
        moments = merge_moments(moments, cells)
    near = p
    for c in cells:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    other = p.select(*cells, F.col("id").alias("oid"), *[F.col(c).alias("o" + c) for c in ("x", "y", "z", "mass")])
    d = g.sub(g.point("ox", "oy", "oz"), g.point("x", "y", "z"))
    r2 = g.dot(d, d)
    met = spread(near).join(other, cells).where((F.col("id") != F.col("oid")) & (r2 > 0))
    w = F.col("mass") * F.col("omass") / (r2 * F.sqrt(r2))
    close = met.groupBy("id").agg(*[F.sum(w * x).alias(n) for x, n in zip(d, ("fx", "fy", "fz"), strict=True)])
    zero = p.select("id", *[F.lit(0.0).alias(c) for c in ("fx", "fy", "fz")])
    return zero.unionByName(close).unionByName(far).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "fz")])
