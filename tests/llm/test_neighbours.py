import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, tile long, dim int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 0, 0.0, 0, 0) for k, v in rows], SCHEMA)


def brute(rows, queries, k):
    good = {}
    for i, v in rows:
        if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for q in sorted(set(queries) & good.keys()):
        a = good[q]
        best = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i) for i, b in good.items() if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_all_nearest_are_found(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(n)]
    rows += [(10_000 + k, rows[k % n][1]) for k in range(min(n, 9))]  # equal vectors under other ids
    rows += [(20_000, None), (20_001, []), (20_002, [0.0] * 16), (20_003, [float("nan")] * 16), (20_004, [1.0, None] + [0.0] * 14), (20_005, [1.0, 2.0]), (None, [1.0] * 16), (20_006, [float("inf")] + [0.0] * 15)]
    rows += rows[:2]
    df = table(spark, rows).repartition(3)
    got = neighbours.nearest(df.where(F.col("vec_id") % 50 == 0), df).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    want = brute(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 24)) * rng.choice([1e-3, 1, 1e3], size=(300, 24))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ints, step, length, rest = neighbours.quantise(u)
    near = (ints.astype(float) @ ints.T) * step[:, None] * step
    assert (np.abs(u @ u.T - near) <= length[:, None] * rest + rest[:, None] + 1e-9).all()


def test_a_thousand_equal_vectors_need_no_memory_for_their_pairs(spark):
    rows = [(k, [1.0, 2.0, -1.0, 0.5]) for k in range(1500)] + [(5000, [1.0, 2.0, -1.0, 0.6])]
    df = table(spark, rows).repartition(3)
    got = neighbours.nearest(df.where(F.col("vec_id") % 50 == 0), df).collect()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in got if r["query_id"] < 1500}
    assert got == {(q, r + 1): v for q in range(0, 1500, 50) for r, v in enumerate([k for k in range(6) if k != q][:5])}


def test_heaps_meet_sorting():
    rng = np.random.default_rng(5)
    heaps = neighbours.Heaps(7, 3)
    q, v, s = rng.integers(0, 7, 4000), rng.integers(0, 60, 4000), rng.integers(0, 9, 4000) / 9
    for k in range(0, 4000, 500):
        heaps.push(q[k : k + 500], s[k : k + 500], v[k : k + 500])
    best = {}
    for a, b, c in zip(q.tolist(), v.tolist(), s.tolist(), strict=True):
        best.setdefault(a, {})[b] = max(c, best.get(a, {}).get(b, -1))
    want = {(a, b, c) for a, own in best.items() for c, b in sorted(((c, b) for b, c in own.items()), key=lambda x: (-x[0], x[1]))[:3]}
    assert set(zip(*(x.tolist() for x in heaps.rows()), strict=True)) == want
