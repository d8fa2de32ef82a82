"""Randomised properties, and edge inputs: empty, one item, all equal, duplicates, loops, isolated vertices."""

import bisect
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import forces, graph, linalg, merkle, mesh, sequence, sets, spatial, text
from sparkloom.plans import blocks
from sparkloom.sources import files, generators


def seq(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"idx long, v {kind}")


def in_order(df, *cols, idx="idx"):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(idx).collect()]


@pytest.mark.parametrize("values", [[], [5], [3, 3, 3, 3, 3], [1, 3, 9, 0, 33, 1, 1], random.Random(1).choices(range(1 << 20), k=57)])
@pytest.mark.parametrize("monoid,unit,fold", [("sum", 0, lambda a, b: a + b), ("max", -(2**31), max), ("min", 2**31, min)])
def test_scans(spark, values, monoid, unit, fold):
    df = seq(spark, values)
    for forward, inclusive in itertools.product((True, False), repeat=2):
        got = in_order(blocks.scan(df, "v", monoid, unit, forward=forward, inclusive=inclusive, block=4), "scan")
        way = values if forward else values[::-1]
        want = list(itertools.accumulate(way, fold, initial=unit))
        want = want[1:] if inclusive else want[:-1]
        assert got == (want if forward else want[::-1])


@pytest.mark.parametrize("values", [[], [7], [2, 2, 2, 1, 1], random.Random(2).choices(range(50), k=200)])
def test_sort_and_selection(spark, values):
    df = seq(spark, values)
    placed = sequence.sort(df.withColumnRenamed("idx", "old"), "v", "old")
    assert in_order(placed, "v", "old") == sorted((v, k) for k, v in enumerate(values))
    keys = spark.createDataFrame([(k,) for k in range(-1, 55, 7)], "key long")
    got = {r["key"]: r["at"] for r in sequence.upper_bound(df, keys, "v", "key").collect()}
    assert got == {k: bisect.bisect_right(sorted(values), k) for k in range(-1, 55, 7)}


@pytest.mark.parametrize("n", [1, 2, 17, 64, 65])
def test_range_extremes(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(10) for _ in range(n)]
    ranges = [(a, b) for a in range(0, n, max(1, n // 9)) for b in range(a, n, max(1, n // 7))]
    q = spark.createDataFrame(ranges, "lo long, hi long")
    for largest in (False, True):
        best = max if largest else min
        for r in sequence.range_extremes(seq(spark, values), q, "v", largest=largest).collect():
            part = values[r["lo"] : r["hi"] + 1]
            assert (r["best"], r["at"]) == (best(part), r["lo"] + part.index(best(part)))


def test_bucket_offsets_and_dictionary(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1, 1, 3)], "key long")
    assert in_order(sequence.bucket_offsets(df, "key", 7), "start", idx="bucket") == [0, 0, 2, 2, 3, 3, 4]
    table = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (3, 7)], "k int, v int")
    gone, asked = spark.createDataFrame([(2,)], "k int"), spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "idx int, k int")
    assert in_order(sets.dictionary(table, gone, asked, "k", "v"), "v") == [2, None, None]
    a, b = (spark.createDataFrame([(x,) for x in s], "x int") for s in ((1, 3, 5, 8, 12), (3, 8, 9, 54)))
    assert {r["x"] for r in sets.union(a, b).collect()} == {1, 3, 5, 8, 9, 12, 54}
    assert {r["x"] for r in sets.intersect(a, b).collect()} == {3, 8} and {r["x"] for r in sets.difference(a, b).collect()} == {1, 5, 12}


def graph_of(spark, n, m, seed):
    rng = random.Random(seed)
    edges = [(k, rng.randrange(n), rng.randrange(n)) for k in range(m)]  # with loops and repeats
    return edges, spark.createDataFrame(edges, "eid long, u long, v long")


@pytest.mark.parametrize("n,m,seed", [(1, 1, 0), (12, 6, 1), (40, 60, 2), (30, 200, 3)])
def test_graphs(spark, n, m, seed):
    edges, df = graph_of(spark, n, m, seed)
    near = {v: {b for _, a, b in edges if a == v} | {a for _, a, b in edges if b == v} for v in range(n)}
    chosen = []
    for v in range(n):
        if not any(c in near[v] - {v} for c in chosen):
            chosen.append(v)
    assert sorted(r["vertex"] for r in graph.independent_set(df, spark.range(n).withColumnRenamed("id", "vertex")).collect()) == chosen
    used, matched = set(), []
    for e, a, b in edges:
        if a != b and not used & {a, b}:
            used |= {a, b}
            matched.append(e)
    assert sorted(r["eid"] for r in graph.matching(df).collect()) == matched
    rng = random.Random(seed)
    weight = {e: rng.randrange(5) for e, _, _ in edges}

    def kruskal(key):
        root, taken = list(range(n)), []
        for e, a, b in sorted(edges, key=key):
            if root[a] != root[b]:
                taken.append(e)
                root = [root[a] if r == root[b] else r for r in root]
        return sorted(taken), root

    forest, root = kruskal(lambda e: (weight[e[0]], e[0]))
    weighted = spark.createDataFrame([(e, a, b, float(weight[e])) for e, a, b in edges], "eid long, u long, v long, weight double")
    assert sorted(r["eid"] for r in graph.minimum_forest(weighted).collect()) == forest
    assert sorted(r["eid"] for r in graph.spanning_forest(df).collect()) == kruskal(lambda e: e[0])[0]
    least = {r: min(v for v in range(n) if root[v] == r) for r in set(root)}
    got = {r["vertex"]: r["root"] for r in graph.components(df, spark.range(n).withColumnRenamed("id", "vertex")).collect()}
    assert got == {v: least[root[v]] for v in range(n)}
    reached, frontier, rounds = {0: 0}, [0], 0
    while frontier:
        rounds += 1
        frontier = sorted({b for v in frontier for b in near[v]} - reached.keys())
        reached |= dict.fromkeys(frontier, rounds)
    visited, k = graph.bfs(graph.symmetric(df), 0)
    assert {r["vertex"]: r["distance"] for r in visited.collect()} == reached and k == rounds


@pytest.mark.parametrize("word", ["a", "aaaaaaaa", "banana", "mississippi", "éàü€é"])
@pytest.mark.parametrize("whole", [False, True])
def test_suffix_arrays(spark, word, whole):
    data = word.encode()
    want = sorted(range(len(data)), key=lambda k: data[k:])
    chars = text.characters(spark.createDataFrame([(1, word)], "k int, t string"), "k", "t")
    found = text.suffix_array(chars, "k", whole)
    assert in_order(found, "pos", idx="rank") == want
    shared = [next((k for k in range(len(data) + 1) if data[a : a + k + 1] != data[b : b + k + 1] or a + k >= len(data) or b + k >= len(data)), 0) for a, b in itertools.pairwise(want)]
    assert in_order(text.common_prefixes(chars, found, "k"), "lcp", idx="rank") == [*shared, None]


def hull_of(points):
    pts = sorted({(x, y) for _, x, y in points})
    ids = {}
    for p, x, y in points:
        ids[x, y] = min(p, ids.get((x, y), p))

    def chain(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) >= 0:
                out.pop()
            out.append(p)
        return out

    if len(pts) == 1:
        return [ids[pts[0]]]
    upper, lower = chain(pts), chain(pts[::-1])
    return [ids[p] for p in upper + lower[1:-1]]


@pytest.mark.parametrize("points", [[(0, 1.0, 1.0)], [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 2.0, 3.0)], [(k, float(k), float(k)) for k in range(6)], [(k, float(k % 5), float(k // 5)) for k in range(25)],
                                    [(k, random.Random(k).random(), random.Random(-k - 1).random()) for k in range(300)], [(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 2.0), (3, 0.0, 1.0)]])
def test_hull(spark, points):
    df = spark.createDataFrame(points, "pid long, x double, y double").repartition(3)
    assert in_order(spatial.hull(df), "pid", idx="place") == hull_of(points)


@pytest.mark.parametrize("n,k", [(1, 2), (3, 5), (200, 4)])
def test_nearest(spark, n, k):
    rng = random.Random(n)
    pts = [(i, rng.choice([rng.random(), 0.5]), rng.random() ** 4) for i in range(n)]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    got = {(r["pid"], r["rank"]): r["other"] for r in spatial.nearest(df, k, ["x", "y"]).collect()}
    want = {}
    for i, x, y in pts:
        order = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in pts if j != i)[:k]
        want |= {(i, r + 1): j for r, (_, j) in enumerate(order)}
    assert got == want


def test_ray_cast_meets_brute_force(spark):
    points, tris, rays = generators.ray_scene(spark, 60)
    got = {r["rid"]: r["tid"] for r in spatial.ray_cast(points, tris, rays).collect()}
    p = {r["pid"]: np.array([r["x"], r["y"], r["z"]]) for r in points.collect()}
    t = {r["tid"]: [p[r[c]] for c in "abc"] for r in tris.collect()}
    hits = 0
    for r in rays.collect():
        o, d = np.array([r["ox"], r["oy"], r["oz"]]), np.array([r["dx"], r["dy"], r["dz"]])
        best = (np.inf, -1)
        for k, (a, b, c) in t.items():
            m = np.stack([b - a, c - a, -d], axis=1)
            if abs(np.linalg.det(m)) > 1e-8:
                u, v, s = np.linalg.solve(m, o - a)
                if u >= 0 and v >= 0 and u + v <= 1 and s > 0:
                    best = min(best, (s, k))
        hits += best[1] >= 0
        assert got[r["rid"]] == best[1]
    assert hits


def test_forces_against_a_plain_sum(spark):
    bodies = generators.particles(generators.plummer(spark, 90), 2.0)
    rows = bodies.orderBy("id").toPandas()
    p = rows[["x", "y", "z"]].to_numpy()
    got = spatial.direct_forces(bodies, tile=16).orderBy("id").toPandas()[["fx", "fy", "fz"]].to_numpy()
    for i in range(len(p)):
        r = np.delete(p, i, axis=0) - p[i]
        want = (4.0 * r / np.linalg.norm(r, axis=1, keepdims=True) ** 3).sum(axis=0)
        assert np.allclose(got[i], want, rtol=1e-9)


@pytest.mark.parametrize("make", [generators.kuzmin, generators.in_sphere, generators.on_sphere])
def test_meshes(spark, make):
    points = make(spark, 80)
    p, t = mesh.delaunay(points)
    r = mesh.check(p, t).first()
    assert (r["bad_sides"], r["bad_circles"], r["triangles"]) == (0, 0, 2 * 80 + 8)
    q, s = mesh.refine(p, t)
    assert spatial.skinny(q, s, 29.9999).isEmpty()
    assert mesh.check(q, s).first()["bad_circles"] == 0


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_merkle(spark, n):
    import hashlib

    data = [bytes([k]) * (k + 3) for k in range(n)]
    nodes = {r["node_id"]: bytes(r["digest"]) for r in merkle.tree(spark.createDataFrame(list(enumerate(data)), "block_id long, data binary")).collect()}
    level = [hashlib.sha256(x).digest() for x in data]
    level += [hashlib.sha256(b"").digest()] * ((1 << (n - 1).bit_length()) - n)
    while len(level) > 1:
        level = [hashlib.sha256(bytes(x | y for x, y in zip(a, b, strict=True))).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
    assert nodes[1] == level[0]


def test_matrix_example(spark):
    m = [[1.0, 2.0, 3.0, 4.0], [0.0, 1.5, 0.0, -1.0], [2.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 0.0]]
    x = [4.3, 0.3, 2.1, 3.3]
    df = spark.createDataFrame([(r, c, m[r][c]) for r in range(4) for c in range(4)], "r int, c int, v double")
    got = in_order(linalg.times_vector(df, spark.createDataFrame(list(enumerate(x)), "c int, x double")), "y", idx="r")
    assert np.allclose(got, np.array(m) @ np.array(x))


def test_wrong_header_is_refused(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    files.write_words(seq(spark, [1, 2]), path, "v", head=["sequenceInt"])
    assert in_order(files.load(spark, path), "v") == [1, 2]
    with pytest.raises(files.WrongHeader):
        files.read_sequence(spark, path, "double", "sequenceDouble")


def test_triangle_and_node_files(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("3 1\n0 0\n1 0\n0 1\n1 2 3\n")
    points, tris = files.read_triangles(spark, str(path), offset=1)
    assert in_order(points, "x", "y", idx="pid") == [(0, 0), (1, 0), (0, 1)] and in_order(tris, "a", "b", "c", idx="tid") == [(0, 1, 2)]
    (tmp_path / "m.node").write_text("3 2 0 1\n1 0 0 0\n2 1 0 0\n3 0 1 0\n")
    (tmp_path / "m.ele").write_text("1 3 0\n1 1 2 3\n")
    points, tris = files.read_node_ele(spark, str(tmp_path / "m.node"), str(tmp_path / "m.ele"))
    assert in_order(points, "x", "y", idx="pid") == [(0, 0), (1, 0), (0, 1)] and in_order(tris, "a", "b", "c", idx="tid") == [(0, 1, 2)]


def test_trigram_words_follow_their_table(spark):
    words = spark.createDataFrame([("aba",), ("ab",), ("cab",)], "word string")
    made = {r["word"] for r in generators.trigram_words(spark, generators.trigram_table(words), 200).collect()}
    assert made <= {"aba", "ab", "cab", "caba"} and len(made) > 1


def test_empty_graphs_and_sets(spark):
    none = spark.createDataFrame([], "eid long, u long, v long")
    assert graph.matching(none).isEmpty() and graph.components(none).isEmpty() and graph.spanning_forest(none).isEmpty()
    assert spatial.hull(spark.createDataFrame([], "pid long, x double, y double")).isEmpty()
    assert sequence.reduce(seq(spark, []), F.col("v"), "sum", 0).first()["v"] == 0


def test_cell_forces_are_near_the_direct_sum(spark):
    bodies = generators.particles(generators.in_sphere(spark, 400, 3))
    exact, near = (f(bodies).orderBy("id").toPandas()[["fx", "fy", "fz"]].to_numpy() for f in (spatial.direct_forces, lambda b: spatial.approximate_forces(b, 3)))
    assert np.mean(np.linalg.norm(near - exact, axis=1) / np.linalg.norm(exact, axis=1)) < 5e-3


def test_multipole_forces_on_clusters(spark):
    bodies = generators.particles(generators.plummer(spark, 1500)).withColumn("mass", F.col("id") % 5 - 1.0).cache()
    twice = bodies.unionByName(bodies.where("id < 20").withColumn("id", F.col("id") + 5000))
    exact, near = (f(twice).orderBy("id").toPandas()[["fx", "fy", "fz"]].to_numpy() for f in (spatial.direct_forces, lambda b: forces.multipole_forces(b, leaf=8)))
    real = np.linalg.norm(exact, axis=1) > 0
    assert real.sum() > 1000 and not near[~real].any()
    assert np.mean(np.linalg.norm((near - exact)[real], axis=1) / np.linalg.norm(exact[real], axis=1)) < 1e-5


def test_multipole_forces_of_few(spark):
    few = lambda rows: forces.multipole_forces(spark.createDataFrame(rows, "id long, x double, y double, z double, mass double")).orderBy("id").collect()
    assert few([]) == [] and [tuple(r) for r in few([(7, 1.0, 1.0, 1.0, 2.0)])] == [(7, 0.0, 0.0, 0.0)]
    assert [tuple(r)[1:] for r in few([(1, 1.0, 1.0, 1.0, 2.0), (2, 1.0, 1.0, 1.0, 3.0)])] == [(0.0, 0.0, 0.0)] * 2
    a, b = few([(1, 0.0, 0.0, 0.0, 2.0), (2, 2.0, 0.0, 0.0, 3.0)])
    assert np.allclose(tuple(a)[1:], (1.5, 0, 0)) and np.allclose(tuple(b)[1:], (-1.5, 0, 0))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_any_size_are_moved_without_listing_their_places(spark):
    """One block of 20,000 items, empty ones and single items; items outside all blocks go. No place is made by explode, as such rows were broadcast."""
    lengths = [20_000, 0, 1, 3, 0, 4096, 1]
    starts = [0, *itertools.accumulate(lengths)][:-1]
    sources = spark.createDataFrame([(k, 0, s, n) for k, (s, n) in enumerate(zip(starts, lengths, strict=True))], "r long, c long, start long, length long")
    places = [1_000_000 * (len(lengths) - k) for k in range(len(lengths))]
    targets = spark.createDataFrame([(k, 0, p) for k, p in enumerate(places)], "r long, c long, to long")
    n = sum(lengths)
    moved = linalg.block_transpose(spark.range(n + 5).selectExpr("id AS idx", "id * 7 AS v"), sources, targets)
    assert "Generate" not in plan_of(moved)
    want = sorted((p + i, (s + i) * 7) for s, p, m in zip(starts, places, lengths, strict=True) for i in range(m))
    assert in_order(moved, "idx", "v") == want


def test_plans_of_many_rows_deal_them_by_their_number(spark):
    """More rows than a task may hold are dealt to more tasks than the session's partitions: adjacency, both directions, words of texts, triangles."""
    from sparkloom.plans import tables

    edges = spark.range(200).selectExpr("id % 10 AS u", "id + 100 AS v")
    most, tables.MOST = tables.MOST, 10
    try:
        assert graph.symmetric(edges).rdd.getNumPartitions() == 40
        assert graph.adjacency(spark, edges).rdd.getNumPartitions() == 20
        assert spatial.topology(edges.selectExpr("u AS tid", "u AS a", "v AS b", "v + 1 AS c")).rdd.getNumPartitions() == 120
        assert graph.edge_array(edges).count() == 200
        counts = text.word_counts(spark.createDataFrame([(1, "a b a " * 100), (2, "c"), (1, "b"), (3, None)], "k int, t string"), "k", "t")
        assert counts.rdd.getNumPartitions() == 10 and sorted(map(tuple, counts.collect())) == [(1, "a", 200), (1, "b", 101), (2, "c", 1)]
    finally:
        tables.MOST = most


@pytest.mark.parametrize("most", [1 << 19, 7])
def test_matrix_product_in_ranges(spark, most):
    from sparkloom.plans import tables

    rng = random.Random(4)
    a, b = ({(rng.randrange(12), rng.randrange(9)): rng.randrange(-5, 6) for _ in range(60)} for _ in range(2))
    b = {(c, r): v for (r, c), v in b.items()}
    want = {}
    for (r, c), v in a.items():
        for (k, c2), w in b.items():
            if k == c:
                want[r, c2] = want.get((r, c2), 0) + v * w
    make = lambda m: spark.createDataFrame([(*k, v) for k, v in m.items()], "r long, c long, v long")
    before, tables.MOST = tables.MOST, most
    try:
        got = linalg.times(make(a), make(b))
        assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(r#") == 0, "products are not shuffled"
        assert {(r["r"], r["c"]): r["v"] for r in got.collect()} == want
    finally:
        tables.MOST = before


def test_suffixes_of_many_texts_and_of_long_ones(spark, monkeypatch):
    """Texts ordered whole in one task, cut into runs of 16 bytes, and texts too long for that give what plain sorting gives."""
    rng = random.Random(5)
    texts = {k: "".join(rng.choices("ab", k=rng.choice([0, 1, 2, 9, 15, 40]))) for k in range(60)}
    chars = text.characters(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t")
    want = {}
    for k, t in texts.items():
        order = sorted(range(len(t)), key=lambda i, t=t: t[i:])
        for r, i in enumerate(order):
            j = order[r + 1] if r + 1 < len(order) else None
            want[k, i] = (r, None if j is None else next(m for m in range(len(t) + 1) if t[i : i + m + 1] != t[j : j + m + 1] or i + m >= len(t) or j + m >= len(t)))
    for most in (text.TOGETHER, 16):
        monkeypatch.setattr(text, "TOGETHER", most)
        found = text.common_prefixes(chars, text.suffix_array(chars, "k"), "k")
        assert {(r["k"], r["pos"]): (r["rank"], r["lcp"]) for r in found.collect()} == want
        assert most < 40 or "Join" not in plan_of(text.common_prefixes(chars, text.suffix_array(chars, "k"), "k"))


def test_nearest_among_uneven_and_coincident_points(spark):
    rng = random.Random(6)
    pts = [(k, float(rng.randrange(6)), 0.0) for k in range(3000)] + [(3000 + k, 1e6 * rng.random(), 1e3 * rng.random()) for k in range(40)]
    got = {(r["pid"], r["rank"]): (r["other"], r["distance"]) for r in spatial.nearest(spark.createDataFrame(pts, "pid long, x double, y double"), 3, ["x", "y"]).collect()}
    at, ids = np.array([p[1:] for p in pts]), np.arange(len(pts))
    d2 = (at[:, None, 0] - at[None, :, 0]) ** 2 + (at[:, None, 1] - at[None, :, 1]) ** 2
    np.fill_diagonal(d2, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2))[:, :3]
    assert got == {(p, r + 1): (int(order[p, r]), float(np.sqrt(d2[p, order[p, r]]))) for p in range(len(pts)) for r in range(3)}


def test_rows_of_explode_are_not_broadcast(spark):
    bodies = spark.range(300).selectExpr("id", "id * 7 % 101 AS x", "id * 13 % 103 AS y", "id * 17 % 107 AS z", "1.0D AS mass")
    assert "BroadcastHashJoin" not in plan_of(spatial.approximate_forces(bodies))
