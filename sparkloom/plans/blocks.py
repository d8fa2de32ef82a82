"""Plans over positions: dense indices, scans by blocks, and trees of blocks.

A window over a whole table sorts all rows in one task. Here positions are cut into blocks of fixed
size instead: blocks are totalled, the totals are scanned the same way, and each block is finished on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import pieces, settle

BLOCK = 4096

#: Monoids: aggregate, combination of two columns.
MONOIDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "and": (F.bool_and, lambda a, b: a & b),
    "or": (F.bool_or, lambda a, b: a | b),
}


def dense_index(df: DataFrame, *order: Column | str, name: str = "idx", rows: int | None = None) -> DataFrame:
    """df with the position of each row in the given total order, from 0: a range-partitioned sort, a count for each partition, and no global window.

    Where the number of rows is known, so many ranges are made that a task sorts about MOST of them at most.
    """
    ranges = df.repartitionByRange(*order) if rows is None else df.repartitionByRange(pieces(df.sparkSession, rows), *order)
    rows = settle(ranges.sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition, so that the rows need no second shuffle
    base = rows.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__b"))
    return rows.join(F.broadcast(base), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__m", "__p", "__i", "__b")


def scans(df: DataFrame, value: str, monoid: str, identity, kinds: dict[str, tuple[bool, bool]], *, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """df with several scans of `value` along `idx` at once. kinds: name of the column -> (forward, inclusive); exclusive scans begin with `identity`."""
    total, combine = MONOIDS[monoid]
    kind = df.schema[value].dataType
    start = F.lit(identity).cast(kind)
    ways = sorted({forward for forward, _ in kinds.values()})
    name = {True: "__ahead", False: "__behind"}
    rows = df.withColumn("__b", F.floor(F.col(idx) / block).cast("long"))
    own = rows.groupBy("__b").agg(total(value).cast(kind).alias("__t"))
    last = df.agg(F.max(idx).alias("m")).first()["m"]
    if last is not None and last // block >= block:
        above = scans(own.withColumnRenamed("__b", "__i"), "__t", monoid, identity, {f"__o{int(w)}": (w, False) for w in ways}, idx="__i", block=block)
        offsets = above.select(F.col("__i").alias("__b"), *[F.col(f"__o{int(w)}").alias(name[w]) for w in ways])
    else:
        order = Window.orderBy("__b")  # at most `block` rows
        frames = {True: order.rowsBetween(Window.unboundedPreceding, -1), False: Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)}
        offsets = own.select("__b", *[F.coalesce(total("__t").over(frames[w]).cast(kind), start).alias(name[w]) for w in ways])
    # A backward frame is a forward one in falling order: frames that begin at the first row are kept up row by row.
    inside = {True: Window.partitionBy("__b").orderBy(idx), False: Window.partitionBy("__b").orderBy(F.desc(idx))}
    out = rows.join(offsets, "__b")
    locals_ = {n: total(value).over(inside[w].rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)).cast(kind) for n, (w, inclusive) in kinds.items()}
    columns = [F.coalesce(combine(F.col(name[kinds[n][0]]), x), F.col(name[kinds[n][0]])).alias(n) for n, x in locals_.items()]
    return out.select(*[c for c in df.columns if c not in kinds], *columns)


def scan(df: DataFrame, value: str, monoid: str, identity, *, idx: str = "idx", forward: bool = True, inclusive: bool = True, out: str = "scan", block: int = BLOCK) -> DataFrame:
    """df with the prefix (or, backwards, suffix) combination of `value` along `idx`."""
    return scans(df, value, monoid, identity, {out: (forward, inclusive)}, idx=idx, block=block)


def range_extremes(df: DataFrame, queries: DataFrame, value: str, *, idx: str = "idx", lo: str = "lo", hi: str = "hi", largest: bool = False) -> DataFrame:
    """queries with at and best: position (leftmost of ties) and value of the least (greatest) value with lo <= idx <= hi.

    Blocks of every power of two are totalled once; a query meets at most two blocks of each level.
    """
    pick = F.max_by if largest else F.min_by
    key = F.struct(F.col("v"), -F.col("i")) if largest else F.struct("v", "i")
    level = df.select(F.lit(0).alias("level"), F.col(idx).cast("long").alias("node"), F.col(value).alias("v"), F.col(idx).cast("long").alias("i"))
    top = df.agg(F.max(idx).alias("m")).first()["m"]
    tree, levels = level, 1 if top is None else int(top).bit_length() + 1
    for k in range(1, levels):
        level = level.groupBy(F.shiftright("node", 1).alias("node")).agg(pick(F.struct("v", "i"), key).alias("x")).select(F.lit(k).alias("level"), "node", "x.v", "x.i")
        tree = tree.unionByName(level)
    tree = settle(tree, "block-tree")
    # At level k the open range is [ceil(lo / 2^k), floor((hi + 1) / 2^k)): an odd left end and an odd right end are taken there.
    a, b = F.col("a"), F.col("b")
    parts = queries.withColumn("__q", F.monotonically_increasing_id())
    parts = settle(parts, "range-queries")
    taken = []
    for k in range(levels):
        left = F.shiftright((F.col(lo) + ((1 << k) - 1)).cast("long"), k)
        right = F.shiftright((F.col(hi) + 1).cast("long"), k)
        own = parts.select("__q", left.alias("a"), right.alias("b")).where("a < b")
        taken.append(own.where(a % 2 == 1).select("__q", F.lit(k).alias("level"), a.alias("node")))
        taken.append(own.where(b % 2 == 1).select("__q", F.lit(k).alias("level"), (b - 1).alias("node")))
    nodes = taken[0]
    for t in taken[1:]:
        nodes = nodes.unionByName(t)
    best = nodes.join(tree, ["level", "node"]).groupBy("__q").agg(pick(F.struct("v", "i"), key).alias("x")).select("__q", F.col("x.i").alias("at"), F.col("x.v").alias("best"))
    return parts.join(best, "__q", "left").drop("__q")
