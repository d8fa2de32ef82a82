"""Vectors and matrices as coordinate tables (r, c, v), and dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.tables import pieces, settle, spread


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def times_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """matrix (r, c, v) by vector (c, x): r, y. Partial sums are made before the shuffle."""
    return matrix.join(vector, "c").groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two coordinate matrices.

    Rows of a and columns of b are cut into ranges of about equal numbers of entries. For each c, the entries of a range of rows go as one list,
    with the list of a range of columns, to the task that sums that block of the product: products are made where they are summed, and not shuffled.
    """
    a, b = settle(a.select("r", "c", "v"), "factor"), settle(b.select(F.col("r").alias("c"), F.col("c").alias("c2"), F.col("v").alias("w")), "factor")
    spark, most = a.sparkSession, max(a.count(), b.count())
    n = pieces(spark, 4 * most)  # each entry makes several products
    lists = lambda m, end, part, *entry: settle(m.repartitionByRange(n, end).withColumn(part, F.spark_partition_id()), "ranges").groupBy("c", part).agg(F.collect_list(F.struct(*entry)).alias(entry[1] + "s"))
    met = lists(a, "r", "rows", "r", "v").join(spread(lists(b, "c2", "columns", "c2", "w")), "c").select("rows", "columns", "vs", "ws")
    entries = met.repartition(n, "rows", "columns").select("rows", "columns", F.explode("vs").alias("x"), "ws").select("rows", "columns", "x", F.explode("ws").alias("y"))
    products = entries.select("rows", "columns", "x.r", F.col("y.c2").alias("c"), (F.col("x.v") * F.col("y.w")).alias("v"))
    return products.groupBy("rows", "columns", "r", "c").agg(F.sum("v").alias("v")).select("r", "c", "v")


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("c").alias("r"), F.col("r").alias("c"), *[x for x in matrix.columns if x not in ("r", "c")])


def block_transpose(items: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Blocks of varying length moved from row order to column order.

    items: idx, v. sources: r, c, start, length of each block; targets: r, c, to. Each item goes to the place of its block plus its place within it: its block is the last that starts
    at or before it, told by a scan, as blocks may have any size.
    """
    heads = sources.join(targets, ["r", "c"]).where("length > 0").select(F.col("start").cast("long").alias("idx"), F.struct("start", "length", "to").alias("block"))
    marked = settle(items.select("idx", "v").join(heads, "idx", "left"), "block-heads")
    told = blocks.scan(marked, "block", "max", None, out="block").where("idx < block.start + block.length")
    return told.select((F.col("block.to") + F.col("idx") - F.col("block.start")).alias("idx"), "v")
