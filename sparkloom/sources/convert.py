"""python -m sparkloom.sources.convert --make uniform_square --n 1000 --out points.txt, or --in a.txt --kind long --out b.parquet"""

from __future__ import annotations

import argparse

from ..session import session
from . import files, generators

_WORDS = "the quick brown fox jumps over a lazy dog while all other animals in this old forest sleep".split()

MAKERS = {
    **{k: getattr(generators, k) for k in ("random_ints", "random_doubles", "exponential_ints", "uniform_square", "in_sphere", "on_sphere", "kuzmin", "plummer")},
    "almost_sorted": lambda spark, n, seed: generators.almost_sorted(spark, n, max(1, n // 100), seed),
    "bounded_ints": lambda spark, n, seed: generators.bounded_ints(spark, n, max(n, 1), seed),
    "pairs": lambda spark, n, seed: generators.with_payload(generators.random_ints(spark, n, seed), 256, seed + 7),
    "trigram_words": lambda spark, n, seed: generators.trigram_words(spark, generators.trigram_table(spark.createDataFrame([(w,) for w in _WORDS], "word string")), n, seed),
}
#: Kinds of more than one table: points and triangles go to --out, rays to --rays.
SCENES = ("ray_scene", "surface_scene")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--make", choices=(*MAKERS, *SCENES))
    p.add_argument("--n", type=int, default=1000)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--in", dest="source")
    p.add_argument("--kind", default="long")
    p.add_argument("--out", required=True)
    p.add_argument("--rays")
    a = p.parse_args(args)
    spark = session("convert")
    if a.make in SCENES:
        points, tris, rays = generators.ray_scene(spark, a.n, a.seed, surface=a.make == "surface_scene")
        files.write_triangles(points, tris, a.out)
        if a.rays:
            files.write_words(rays.withColumnRenamed("rid", "idx"), a.rays, "ox", "oy", "oz", "dx", "dy", "dz")
        return
    df = MAKERS[a.make](spark, a.n, seed=a.seed) if a.make else files.load(spark, a.source, a.kind)
    idx = next((c for c in ("idx", "pid", "eid", "tid", "u") if c in df.columns), df.columns[0])
    files.store(df, a.out, *[c for c in df.columns if c != idx or idx == "u"], idx=idx)


if __name__ == "__main__":
    main()
