"""Table functions that make test data: every row is computed from its own id, so any range can be made anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Portable(int):
    """A seed whose hashes other engines can repeat: 52 bits of an MD5 of the seeds as text. Plain seeds hash faster."""

    def __add__(self, other: int) -> Portable:
        return Portable(int(self) + other)


def bits(seed: int, *more: Column | int) -> Column:
    """A long from a hash of the seeds: of all 64 bits for a plain seed, of 52 for a portable one."""
    seeds = [F.lit(int(s)) if isinstance(s, int) else s for s in (seed, *more)]
    if isinstance(seed, Portable):
        return F.conv(F.substring(F.md5(F.concat_ws(",", *[s.cast("string") for s in seeds])), 1, 13), 16, 10).cast("long")
    return F.xxhash64(*seeds)


def unit(seed: int, *more: Column | int) -> Column:
    """A double in [0, 1) from a hash of the seeds."""
    if isinstance(seed, Portable):
        return bits(seed, *more) / float(1 << 52)
    return F.shiftrightunsigned(bits(seed, *more), 11) / float(1 << 53)


def _int(seed: int, *more: Column | int) -> Column:
    """An int from 0 from the high 31 bits of a hash."""
    return F.shiftrightunsigned(bits(seed, *more), 21 if isinstance(seed, Portable) else 33).cast("int")


def _range(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "idx")


def random_ints(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _range(spark, n).select("idx", _int(seed, F.col("idx")).alias("v"))


def random_doubles(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _range(spark, n).select("idx", unit(seed, F.col("idx")).alias("v"))


def bounded_ints(spark: SparkSession, n: int, bound: int, seed: int = 0) -> DataFrame:
    return _range(spark, n).select("idx", F.pmod(bits(seed, F.col("idx")), F.lit(bound)).alias("v"))


def almost_sorted(spark: SparkSession, n: int, swaps: int, seed: int = 0) -> DataFrame:
    """0..n-1 after `swaps` exchanges, one after the other, of two hashed places."""
    if n < 1:
        return _range(spark, 0).select("idx", F.col("idx").alias("v"))
    pairs = spark.range(swaps).select(F.pmod(bits(seed, 1, F.col("id")), F.lit(n)).alias("a"), F.pmod(bits(seed, 2, F.col("id")), F.lit(n)).alias("b"), "id").orderBy("id")
    moved: dict[int, int] = {}
    for r in pairs.collect():  # `swaps` rows, a parameter
        a, b = r["a"], r["b"]
        moved[a], moved[b] = moved.get(b, b), moved.get(a, a)
    changed = spark.createDataFrame(list(moved.items()), "idx long, w long")
    return _range(spark, n).join(changed, "idx", "left").select("idx", F.coalesce("w", "idx").alias("v"))


def all_same(spark: SparkSession, n: int, value) -> DataFrame:
    return _range(spark, n).select("idx", F.lit(value).alias("v"))


def exponential_ints(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A hash of a number below 2^(j+1) and from 2^j, j uniform: few values make up most of the rows."""
    levels = max(1, int(math.log2(max(n, 2))) + 1)
    j = F.floor(unit(seed, 1, F.col("idx")) * levels)
    pick = F.pow(F.lit(2.0), j) + F.floor(unit(seed, 2, F.col("idx")) * F.pow(F.lit(2.0), j))
    return _range(spark, n).select("idx", _int(seed, pick.cast("long")).alias("v"))


def with_payload(df: DataFrame, bound: int, seed: int = 7) -> DataFrame:
    """A second column w in [0, bound)."""
    return df.withColumn("w", F.pmod(bits(seed, F.col("idx")), F.lit(bound)))


def _points(df: DataFrame, *axes: Column) -> DataFrame:
    return df.select(F.col("idx").alias("pid"), *[a.alias(n) for a, n in zip(axes, "xyz", strict=False)])


def uniform_square(spark: SparkSession, n: int, dims: int = 2, seed: int = 0) -> DataFrame:
    """Uniform in [-1, 1]^dims."""
    return _points(_range(spark, n), *[2 * unit(seed, k, F.col("idx")) - 1 for k in range(dims)])


def _direction(dims: int, seed: int) -> tuple[Column, ...]:
    turn = 2 * math.pi * unit(seed, 11, F.col("idx"))
    if dims == 2:
        return F.cos(turn), F.sin(turn)
    z = 2 * unit(seed, 12, F.col("idx")) - 1
    flat = F.sqrt(1 - z * z)
    return flat * F.cos(turn), flat * F.sin(turn), z


def in_sphere(spark: SparkSession, n: int, dims: int = 2, seed: int = 0) -> DataFrame:
    radius = F.pow(unit(seed, 10, F.col("idx")), F.lit(1.0 / dims))
    return _points(_range(spark, n), *[radius * x for x in _direction(dims, seed)])


def on_sphere(spark: SparkSession, n: int, dims: int = 2, seed: int = 0) -> DataFrame:
    return _points(_range(spark, n), *_direction(dims, seed))


def kuzmin(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    s = unit(seed, 10, F.col("idx"))
    radius = F.sqrt(1 / ((1 - s) * (1 - s)) - 1)
    return _points(_range(spark, n), *[radius * x for x in _direction(2, seed)])


def plummer(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    s = F.pow(unit(seed, 10, F.col("idx")), F.lit(2.0 / 3.0))
    radius = F.sqrt(s / F.greatest(1 - s, F.lit(2.0**-53)))  # a power that is rounded up to 1 would have no radius
    return _points(_range(spark, n), *[radius * x for x in _direction(3, seed)])


def particles(points: DataFrame, mass: float = 1.0) -> DataFrame:
    return points.select(F.col("pid").alias("id"), "x", "y", "z", F.lit(mass).alias("mass"))


def ray_scene(spark: SparkSession, n: int, seed: int = 0, surface: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points, tris, rays: n triangles p, p + (d, d, 0), p + (d, 0, d) with d = 1 / sqrt(n) and p in [-1, 1]^3 or on the unit sphere, and n rays through their box from low to high z."""
    d = 1 / math.sqrt(max(n, 1))
    at = _direction(3, seed) if surface else tuple(2 * unit(seed, k, F.col("idx")) - 1 for k in range(3))
    base = _range(spark, n).select("idx", *[x.alias(c) for x, c in zip(at, "xyz", strict=True)])
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for k, (dx, dy, dz) in enumerate(((0.0, 0.0, 0.0), (d, d, 0.0), (d, 0.0, d)))])).alias("c")
    points = base.select("idx", "x", "y", "z", corners).select((F.col("idx") * 3 + F.col("c.k")).alias("pid"), (F.col("x") + F.col("c.dx")).alias("x"), (F.col("y") + F.col("c.dy")).alias("y"), (F.col("z") + F.col("c.dz")).alias("z"))
    tris = base.select(F.col("idx").alias("tid"), (F.col("idx") * 3).alias("a"), (F.col("idx") * 3 + 1).alias("b"), (F.col("idx") * 3 + 2).alias("c"))
    return points, tris, rays_through(spark, points, n, seed + 1)


def rays_through(spark: SparkSession, points: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """rid, origin and direction of n rays from the low-z face of the points' box to its high-z face."""
    b = points.agg(*[f(c).alias(m + c) for c in "xyz" for m, f in (("a", F.min), ("b", F.max))]).first()
    if b["ax"] is None:
        return spark.range(0).select(F.col("id").alias("rid"), *[F.lit(0.0).alias(x) for x in ("ox", "oy", "oz", "dx", "dy", "dz")])
    at = lambda c, k: b["a" + c] + (b["b" + c] - b["a" + c]) * unit(seed, k, F.col("rid"))
    rays = spark.range(n).select(F.col("id").alias("rid")).select("rid", at("x", 1).alias("ox"), at("y", 2).alias("oy"), F.lit(b["az"]).alias("oz"), at("x", 3).alias("ex"), at("y", 4).alias("ey"))
    return rays.select("rid", "ox", "oy", "oz", (F.col("ex") - F.col("ox")).alias("dx"), (F.col("ey") - F.col("oy")).alias("dy"), F.lit(b["bz"] - b["az"]).alias("dz"))


def byte_blocks(spark: SparkSession, n: int, size: int, seed: int = 0) -> DataFrame:
    """block_id, data: blocks of `size` hashed bytes."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-size // 32) - 1))), lambda k: F.sha2(F.concat_ws(",", F.lit(seed), F.col("id"), k), 256))
    return spark.range(n).select(F.col("id").alias("block_id"), F.unhex(F.substring(F.array_join(chunks, ""), 1, 2 * size)).alias("data"))


def nested_rows(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """seg, pos, v: row i has i items."""
    rows = spark.range(1, n).select(F.col("id").alias("seg"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("pos"))
    return rows.select("seg", "pos", F.pmod(bits(seed, F.col("seg"), F.col("pos")), F.lit(256)).cast("int").alias("v"))


def permutation(spark: SparkSession, n: int, start: int | None = None) -> DataFrame:
    """idx, v: v = idx * k mod n for the first k from `start` on that shares no divisor with n."""
    k = start if start is not None else max(1, n * 5 // 8)
    while n > 1 and math.gcd(k, n) != 1:
        k += 1
    return _range(spark, n).select("idx", F.pmod(F.col("idx") * (k % max(n, 1)), F.lit(max(n, 1))).alias("v"))


# --- trigram words ------------------------------------------------------------------------------------


def trigram_table(words: DataFrame, word: str = "word") -> DataFrame:
    """prefix (two characters, `_` before the word), char (`_` ends it), cum: cumulative share of the next character after each prefix."""
    from pyspark.sql import Window

    padded = F.concat(F.lit("__"), F.col(word), F.lit("_"))
    grams = words.where(F.length(word) > 0).select(padded.alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring("p", i, F.lit(3)))).alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("n")).select(F.substring("g", 1, 2).alias("prefix"), F.substring("g", 3, 1).alias("char"), "n")
    upto = Window.partitionBy("prefix").orderBy("char").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("prefix", "char", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("prefix"))).alias("cum"))


def trigram_words(spark: SparkSession, table: DataFrame, n: int, seed: int = 0, longest: int = 100) -> DataFrame:
    """idx, word: walks through a trigram table, all words by one letter a round, as joins."""
    from ..plans.tables import settle

    steps = table.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("cum", "char"))).alias("next"))
    open_ = spark.range(n).select(F.col("id").alias("idx"), F.lit("__").alias("prefix"), F.lit("").alias("word"))
    done = None
    for k in range(longest):
        drawn = open_.join(steps, "prefix", "left").withColumn("u", unit(seed, k, F.col("idx")))
        letter = F.coalesce(F.get(F.filter("next", lambda x: x["cum"] > F.col("u")), F.lit(0))["char"], F.lit("_"))
        walked = settle(drawn.select("idx", "prefix", "word", letter.alias("c")), "trigram-words")
        ended = walked.where("c = '_'").select("idx", "word")
        done = ended if done is None else done.unionByName(ended)
        open_ = walked.where("c <> '_'").select("idx", F.concat(F.substring("prefix", 2, 1), "c").alias("prefix"), F.concat("word", "c").alias("word"))
        if open_.isEmpty():
            return done
    return done.unionByName(open_.select("idx", "word"))
