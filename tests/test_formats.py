"""Binary formats against bytes packed by hand, in the layouts that other programs write."""

import struct

import numpy as np
import pytest

from sparkloom.sources import convert, files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_strings(spark, tmp_path):
    names = ["a", "", "größe", "z z"]
    raw = [n.encode() for n in names]
    sizes = struct.pack("<q", 4) + b"".join(struct.pack("<i", len(r)) for r in raw)
    (tmp_path / "s.bin").write_bytes(sizes + b"".join(raw))
    (tmp_path / "n.bin").write_bytes(sizes + b"".join(r + struct.pack("<i", k - 2) for k, r in enumerate(raw)))
    assert rows(files.load(spark, str(tmp_path / "s.bin"), "string"), "idx") == list(enumerate(names))
    assert rows(files.load(spark, str(tmp_path / "n.bin"), "string pair"), "idx") == [(k, n, k - 2) for k, n in enumerate(names)]
    (tmp_path / "e.bin").write_bytes(struct.pack("<q", 0))
    assert files.load(spark, str(tmp_path / "e.bin"), "string").count() == 0


@pytest.mark.parametrize("kind", ["<i4", "<i8"])
def test_graphs(spark, tmp_path, kind):
    degree, heads = [2, 0, 1], [1, 2, 0]
    (tmp_path / "g.bin").write_bytes(np.array([3, 3, *degree, *heads], kind).tobytes())
    assert rows(files.load(spark, str(tmp_path / "g.bin"), "graph"), "u", "v") == [(0, 1), (0, 2), (2, 0)]


def test_a_wrong_size_is_told(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(np.array([3, 3, 2, 0, 1, 1, 2], "<i4").tobytes() + b"\0" * 16)
    with pytest.raises(Exception, match="the head asks for"):
        files.load(spark, str(tmp_path / "g.bin"), "graph").collect()


@pytest.mark.parametrize("dims", [2, 3])
def test_triangles_and_rays(spark, tmp_path, dims):
    points, tris, rays = np.arange(4 * dims) / 7, np.array([[0, 1, 2], [1, 2, 3]], "<i4"), np.arange(12) / 3
    shapes = struct.pack("<q", 4) + points.astype("<f8").tobytes() + struct.pack("<q", 2) + tris.tobytes()
    (tmp_path / "t.bin").write_bytes(shapes)
    p, t = files.load(spark, str(tmp_path / "t.bin"), "triangles" if dims == 2 else "triangles3d")
    assert rows(p, "pid") == [(k, *points[k * dims : k * dims + dims].tolist()) for k in range(4)] and rows(t, "tid") == [(0, 0, 1, 2), (1, 1, 2, 3)]
    if dims == 3:
        (tmp_path / "r.bin").write_bytes(shapes + struct.pack("<q", 2) + rays.astype("<f8").tobytes())
        p, t, r = files.load(spark, str(tmp_path / "r.bin"), "rays")
        assert rows(t, "tid") == [(0, 0, 1, 2), (1, 1, 2, 3)] and rows(r, "rid") == [(k, *rays[6 * k : 6 * k + 6].tolist()) for k in range(2)]


def test_import_without_the_corpus_operators(tmp_path):
    """A copy without them still imports, and offers all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for pipeline in (False, True):
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_sum' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.parametrize("kind", ["almost_sorted", "bounded_ints", "pairs", "trigram_words", "plummer"])
def test_converter_makes_each_kind(spark, tmp_path, kind):
    path = str(tmp_path / "made.parquet")
    convert.main(["--make", kind, "--n", "60", "--seed", "3", "--out", path])
    made = spark.read.parquet(path)
    assert made.count() == 60
    if kind == "almost_sorted":
        assert sorted(r["v"] for r in made.collect()) == list(range(60))


@pytest.mark.parametrize("kind", convert.SCENES)
def test_converter_makes_scenes(spark, tmp_path, kind):
    a, b = str(tmp_path / "scene.txt"), str(tmp_path / "rays.txt")
    convert.main(["--make", kind, "--n", "20", "--out", a, "--rays", b])
    points, tris, rays = files.load(spark, a, "rays", b)
    assert (points.count(), tris.count(), rays.count()) == (60, 20, 20)
    assert all(r["dz"] > 0 for r in rays.collect())


def test_text_of_many_files_is_read_in_their_order(spark, tmp_path):
    """Spark deals the largest files first; the first line and all words must still come in the order of the files."""
    (tmp_path / "long.txt").mkdir()
    for k, lines in enumerate((["sequenceInt"], [], range(5), range(5, 4000), range(4000, 4002))):
        (tmp_path / "long.txt" / f"part-{k:05}").write_text("".join(f"{x}\n" for x in lines))
    for width in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)
        try:
            assert rows(files.load(spark, str(tmp_path / "long.txt")), "idx") == [(k, k) for k in range(4002)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_graph_in_many_files(spark, tmp_path):
    edges = spark.range(3000).selectExpr("id % 50 AS u", "id DIV 50 + 1000 AS v")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_graph(edges, files.rows_of(edges), str(tmp_path / "g.txt"), "AdjacencyGraph")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert rows(files.load(spark, str(tmp_path / "g.txt")), "u", "v") == rows(edges, "u", "v")
