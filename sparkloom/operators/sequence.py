"""Operators over sequences: a sequence is a table with a dense position `idx` from 0 and a value column.

Positions are always a column; nothing depends on the order in which rows are stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import blocks

# --- maps, filters, packs -------------------------------------------------------------------------


def tabulate(spark: SparkSession, n: int, value: Callable[[Column], Column]) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), value(F.col("id")).alias("v"))


def each(df: DataFrame, value: Callable[[Column], Column], v: str = "v") -> DataFrame:
    """A map over values; position and other columns stay."""
    return df.withColumn(v, value(F.col(v)))


def keep(df: DataFrame, holds: Column) -> DataFrame:
    """A filter that keeps order, as positions stay."""
    return df.where(holds)


def compact(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Dense positions again after a filter."""
    return blocks.dense_index(df.withColumnRenamed(idx, "__old"), "__old", name=idx).drop("__old")


def pack(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows whose position has a true flag (flags: idx, flag)."""
    return df.join(flags.where("flag").select("idx"), "idx", "left_semi")


def pack_index(flags: DataFrame) -> DataFrame:
    return flags.where("flag").select("idx")


def split(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows of two sides, told by a column side (left wins where both hold); rows of neither go."""
    return df.withColumn("side", F.when(left, "left").when(right, "right")).where("side IS NOT NULL")


def count_pairs(spark: SparkSession, n: int, m: int) -> DataFrame:
    """n * m passes of a nested loop, counted without pairing rows."""
    return spark.range(n).agg((F.count("*") * m).alias("n"))


# --- reductions -----------------------------------------------------------------------------------


def reduce(df: DataFrame, value: Column, monoid: str, identity) -> DataFrame:
    """One row; the identity for an empty sequence."""
    return df.agg(F.coalesce(blocks.MONOIDS[monoid][0](value), F.lit(identity)).alias("v"))


def reduce_nested(df: DataFrame, items: Column, identity) -> DataFrame:
    """The greatest item of a sequence of arrays."""
    return df.agg(F.coalesce(F.max(F.array_max(items)), F.lit(identity)).alias("v"))


def fold_custom(df: DataFrame, value: str, init: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """A monoid given by its unit and combination, over an array column: an expression, not a UDF."""
    return F.aggregate(F.col(value), init, merge)


def arg_max(df: DataFrame, value: Column, idx: str = "idx", least: bool = False) -> DataFrame:
    """Position of the greatest (least) value, the first of equals."""
    pick = F.min_by(F.col(idx), F.struct(value, F.col(idx))) if least else F.max_by(F.col(idx), F.struct(value, -F.col(idx)))
    return df.agg(pick.alias("idx"))


def bounding_box(df: DataFrame, *axes: str) -> DataFrame:
    return df.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def ends(df: DataFrame, x: str = "x", y: str = "y", idx: str = "idx") -> DataFrame:
    """Leftmost point (then lowest) and rightmost point (the later of equals)."""
    return df.agg(F.min_by(idx, F.struct(x, y, idx)).alias("leftmost"), F.max_by(idx, F.struct(x, idx)).alias("rightmost"))


def count_if(df: DataFrame, holds: Column) -> DataFrame:
    return df.agg(F.count_if(holds).alias("n"))


def nested_count_if(df: DataFrame, segment: str, holds: Column) -> DataFrame:
    return df.groupBy(segment).agg(F.count_if(holds).alias("n"))


def bucket_offsets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Of each key in [0, buckets): where its run begins in key order; a missing key has the next one's place."""
    counts = df.groupBy(F.col(key).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["n"])
    return blocks.scan(all_, "n", "sum", 0, idx="bucket", inclusive=False, out="start").select("bucket", "start")


def write_back(df: DataFrame, target: str, value: str, how: str) -> DataFrame:
    """Many writers to one cell, resolved at once: how is min, max or sum."""
    return df.groupBy(target).agg(getattr(F, how)(value).alias(value))


def mean_relative_error(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(guess) - F.col(truth)) / F.abs(F.col(truth))).alias("error"))


# --- scans and neighbours ---------------------------------------------------------------------------

scan, scans = blocks.scan, blocks.scans


def all_scans(df: DataFrame, value: str, monoid: str, identity, idx: str = "idx") -> DataFrame:
    """Forward and backward, exclusive and inclusive: columns fe, fi, be, bi."""
    kinds = {"fe": (True, False), "fi": (True, True), "be": (False, False), "bi": (False, True)}
    return blocks.scans(df, value, monoid, identity, kinds, idx=idx)


def weights(df: DataFrame, weight: Column, idx: str = "idx") -> DataFrame:
    """idx, before: the weight of all that stands before each position."""
    rows = df.select(idx, weight.cast("long").alias("w"))
    return blocks.scan(rows, "w", "sum", 0, idx=idx, inclusive=False, out="before")


def weight_of(prefix: DataFrame, ranges: DataFrame, idx: str = "idx") -> DataFrame:
    """ranges (lo, hi) with weight: that of the positions lo <= idx < hi, a difference of two prefix weights."""
    at = prefix.select(F.col(idx).alias("lo"), F.col("before").alias("from_"))
    until = prefix.select(F.col(idx).alias("last"), (F.col("before") + F.col("w")).alias("to_"))
    return ranges.withColumn("last", F.col("hi") - 1).join(at, "lo").join(until, "last", "left").select("lo", "hi", F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.col("to_") - F.col("from_")).alias("weight"))


def boundaries(df: DataFrame, value: Column, idx: str = "idx") -> DataFrame:
    """Positions whose value differs from the next one's: a self-join on neighbours, no global window."""
    rows = df.select(F.col(idx).alias("idx"), value.alias("v"))
    following = rows.select((F.col("idx") - 1).alias("idx"), F.col("v").alias("next"))
    return rows.join(following, "idx").where(~F.col("v").eqNullSafe(F.col("next"))).select("idx")


def naming(df: DataFrame, *order: str) -> DataFrame:
    """Dense names, from 0, of rows by the given columns: equal rows share a name."""
    names = blocks.dense_index(df.select(*order).distinct(), *order, name="name")
    return df.join(names, list(order))


range_extremes = blocks.range_extremes

# --- sorts, merges, selection -----------------------------------------------------------------------


def sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """idx is the place in sorted order; end `order` with a unique column, as the old position, for a stable sort."""
    return blocks.dense_index(df, *order)


def merge(a: DataFrame, b: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """Two sorted sequences as one; of equal keys those of `a` come first."""
    both = a.withColumn("__s", F.lit(0)).unionByName(b.withColumn("__s", F.lit(1))).withColumnRenamed(idx, "__old")
    return blocks.dense_index(both, key, "__s", "__old", name=idx).drop("__s", "__old")


def upper_bound(df: DataFrame, queries: DataFrame, value: str, key: str) -> DataFrame:
    """queries with at: how many values are <= their key; values and keys are sorted together and counted by a scan."""
    rows = df.select(F.col(value).alias("__v"), F.lit(0).alias("__s"), F.lit(1).cast("long").alias("__one"))
    asked = queries.select(key).distinct().select(F.col(key).alias("__v"), F.lit(1).alias("__s"), F.lit(0).cast("long").alias("__one"))
    order = blocks.dense_index(rows.unionByName(asked), "__v", "__s", name="__at")
    told = blocks.scan(order, "__one", "sum", 0, idx="__at", out="at").where("__s = 1").select(F.col("__v").alias(key), "at")
    return queries.join(told, key)


def almost_kth(df: DataFrame, value: str, share: float, accuracy: int = 10_000) -> DataFrame:
    """df split stably by an approximate quantile: side lower (< pivot) or upper."""
    pivot = df.agg(F.percentile_approx(value, share, accuracy).alias("p")).first()["p"]
    return df.withColumn("side", F.when(F.col(value) < F.lit(pivot), "lower").otherwise("upper"))


def rank_within(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
