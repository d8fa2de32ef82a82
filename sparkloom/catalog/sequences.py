"""Queries of the sequence operators, over orders in order of o_orderkey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import monoids
from ..operators import sequence as seq
from .base import ORDERS, Registry, orders, read

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _scans(value: str, agg: str, identity: str, cast: str) -> str:
    frames = {"fe": "UNBOUNDED PRECEDING AND 1 PRECEDING", "fi": "UNBOUNDED PRECEDING AND CURRENT ROW", "be": "1 FOLLOWING AND UNBOUNDED FOLLOWING", "bi": "CURRENT ROW AND UNBOUNDED FOLLOWING"}
    cols = ", ".join(f"CAST(coalesce({agg}({value}) OVER (ORDER BY idx ROWS BETWEEN {f}), {identity}) AS {cast}) AS {n}" for n, f in frames.items())
    return f"SELECT idx, {cols} FROM {ORDERS}"


@query(_scans("cents", "sum", "0", "BIGINT"))
def scan_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.all_scans(orders(spark, sf_dir), "cents", "sum", 0).select("idx", "fe", "fi", "be", "bi")


@query(_scans("price", "max", "-1", "DOUBLE"))
def scan_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.all_scans(orders(spark, sf_dir), "price", "max", -1.0).select("idx", "fe", "fi", "be", "bi")


@query(f"SELECT idx, cents * 2 + idx AS v FROM {ORDERS}")
def map_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("idx", (F.col("cents") * 2 + F.col("idx")).alias("v"))


@query("SELECT range AS idx, range * range AS v FROM range(100000)")
def tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.tabulate(spark, 100_000, lambda i: i * i)


@query(f"SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, cents FROM {ORDERS} WHERE status = 'F'")
def filter_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.compact(seq.keep(orders(spark, sf_dir), F.col("status") == "F")).select("idx", "cents")


@query(f"SELECT idx, cents FROM {ORDERS} WHERE price > 100000")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return seq.pack(rows, rows.select("idx", (F.col("price") > 100000).alias("flag"))).select("idx", "cents")


@query(f"SELECT idx FROM {ORDERS} WHERE status = 'O'")
def pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.pack_index(orders(spark, sf_dir).select("idx", (F.col("status") == "O").alias("flag")))


@query(f"SELECT idx, CASE WHEN price < 50000 THEN 'left' ELSE 'right' END AS side FROM {ORDERS} WHERE price < 50000 OR price > 150000")
def two_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.split(orders(spark, sf_dir), F.col("price") < 50000, F.col("price") > 150000).select("idx", "side")


@query("SELECT CAST(3000 * 2000 AS BIGINT) AS n")
def nested_loop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.count_pairs(spark, 3000, 2000)


@query(f"SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS total, max(price) AS most, min(price) AS least FROM {ORDERS}")
def reduce_monoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("total"), F.max("price").alias("most"), F.min("price").alias("least"))


@query("SELECT coalesce(max(l_quantity), -1) AS v FROM lineitem")
def reduce_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("items"))
    return seq.reduce_nested(nested, F.col("items"), -1.0)


@query(f"SELECT CAST(sum(CAST(cents * (idx % 7) AS BIGINT)) AS BIGINT) AS v FROM {ORDERS}")
def reduce_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.reduce(orders(spark, sf_dir), F.col("cents") * (F.col("idx") % 7), "sum", 0)


@query(f"SELECT cust, min(cents) AS low, max(cents) AS high FROM {ORDERS} GROUP BY cust")
def reduce_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = orders(spark, sf_dir).groupBy("cust").agg(F.collect_list("cents").alias("items"))
    unit = F.struct(F.lit(2**62).alias("low"), F.lit(-(2**62)).alias("high"))
    both = seq.fold_custom(lists, "items", unit, lambda s, x: F.struct(F.least(s["low"], x).alias("low"), F.greatest(s["high"], x).alias("high")))
    return lists.select("cust", both.alias("r")).select("cust", "r.low", "r.high")


@query(f"SELECT (SELECT idx FROM {ORDERS} ORDER BY price DESC, idx LIMIT 1) AS most, (SELECT idx FROM {ORDERS} ORDER BY price, idx LIMIT 1) AS least")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return rows.agg(F.max_by("idx", F.struct("price", -F.col("idx"))).alias("most"), F.min_by("idx", F.struct("price", "idx")).alias("least"))


@query("SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.bounding_box(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query("""SELECT (SELECT c_custkey FROM customer ORDER BY c_nationkey, c_acctbal, c_custkey LIMIT 1) AS leftmost, (SELECT c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 1) AS rightmost""")
def extreme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.ends(read(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_custkey")


@query("SELECT count(*) AS n FROM lineitem WHERE (l_partkey * 31 + l_suppkey) % 97 = 5 AND l_returnflag = 'R'")
def count_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.count_if(read(spark, sf_dir, "lineitem"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 97 == 5) & (F.col("l_returnflag") == "R"))


@query("SELECT l_orderkey AS seg, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_orderkey")
def nested_count_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.nested_count_if(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "seg"), "seg", F.col("l_discount") > 0.05)


@query("SELECT b.range AS bucket, (SELECT count(*) FROM orders WHERE o_custkey < b.range) AS start FROM range((SELECT max(o_custkey) + 3 FROM orders)) b")
def bucket_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    top = rows.agg(F.max("cust").alias("m")).first()["m"]
    return seq.bucket_offsets(rows, "cust", top + 3)


@query(f"SELECT cust, min(cents) AS low, max(cents) AS high, CAST(sum(cents) AS BIGINT) AS total FROM {ORDERS} GROUP BY cust")
def priority_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy("cust").agg(F.min("cents").alias("low"), F.max("cents").alias("high"), F.sum("cents").alias("total"))


@query("SELECT round(avg(abs(l_extendedprice * (1 - l_discount) - l_extendedprice) / abs(l_extendedprice)), 9) AS error FROM lineitem")
def relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return seq.mean_relative_error(rows, "l_extendedprice", "net").select(F.round("error", 9).alias("error"))


@query(f"""WITH r AS (SELECT DISTINCT min(idx) AS lo, max(idx) AS hi FROM {ORDERS} GROUP BY cust), p AS (SELECT idx, coalesce(sum(cents) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, cents FROM {ORDERS})
SELECT lo, hi, CAST(CASE WHEN hi <= lo THEN 0 ELSE b.before + b.cents - a.before END AS BIGINT) AS weight FROM r JOIN p a ON a.idx = lo LEFT JOIN p b ON b.idx = hi - 1""")
def prefix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    ranges = rows.groupBy("cust").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).select("lo", "hi").distinct()
    return seq.weight_of(seq.weights(rows, F.col("cents")), ranges)


@query(f"SELECT idx, dense_rank() OVER (ORDER BY priority, status) - 1 AS name FROM {ORDERS}")
def dense_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.naming(orders(spark, sf_dir), "priority", "status").select("idx", "name")


@query(f"SELECT idx FROM (SELECT idx, status, lead(status) OVER (ORDER BY idx) AS n FROM {ORDERS}) WHERE n IS NOT NULL AND n <> status")
def run_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.boundaries(orders(spark, sf_dir), F.col("status"))


@query(f"""WITH o AS {ORDERS}, r AS (SELECT cust, min(idx) AS lo, max(idx) AS hi FROM o GROUP BY cust)
SELECT r.cust, lo, hi, arg_min(idx, (price, idx)) AS at, min(price) AS best FROM r JOIN o ON idx BETWEEN lo AND hi GROUP BY r.cust, lo, hi""")
def range_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    ranges = rows.groupBy("cust").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return seq.range_extremes(rows, ranges, "price").select("cust", "lo", "hi", "at", "best")


@query(f"SELECT row_number() OVER (ORDER BY price, idx) - 1 AS place, idx FROM {ORDERS}")
def sort_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumnRenamed("idx", "old")
    return seq.sort(rows, "price", "old").select(F.col("idx").alias("place"), F.col("old").alias("idx"))


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place, o_orderkey AS idx, o_custkey AS cust FROM orders")
def sort_integer_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumnRenamed("idx", "old")
    return seq.sort(rows, "cust", "old").select(F.col("idx").alias("place"), F.col("old").alias("idx"), "cust")


@query("""WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
SELECT row_number() OVER (ORDER BY k, s, i) - 1 AS idx, k, s FROM (SELECT k, 0 AS s, i FROM a UNION ALL SELECT k, 1, i FROM b)""")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = seq.sort(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k").withColumn("s", F.lit(0))
    b = seq.sort(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k").withColumn("s", F.lit(1))
    return seq.merge(a, b, "k").select("idx", "k", "s")


@query(f"SELECT DISTINCT p_retailprice * 100 AS key, (SELECT count(*) FROM {ORDERS} WHERE price <= p_retailprice * 100) AS at FROM part")
def upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "part").select((F.col("p_retailprice") * 100).alias("key")).distinct()
    return seq.upper_bound(orders(spark, sf_dir), keys, "price", "key").select("key", "at")


@query(f"SELECT idx, true AS near FROM {ORDERS}")
def approximate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side holds half of the rows, but for one in a thousand, and no lower one is above an upper one."""
    split = seq.almost_kth(orders(spark, sf_dir), "price", 0.5).select("idx", "side", "price")
    sides = split.agg(F.count("*").alias("n"), F.count_if(F.col("side") == "lower").alias("lower"), F.max(F.when(F.col("side") == "lower", F.col("price"))).alias("high"), F.min(F.when(F.col("side") == "upper", F.col("price"))).alias("low"))
    near = (F.abs(F.col("lower") - F.col("n") / 2) <= F.col("n") / 1000 + 1) & (F.col("high") <= F.col("low"))
    return split.crossJoin(sides.select(near.alias("near"))).select("idx", "near")


@query(f"SELECT CAST(bit_or(cents) AS BIGINT) AS v FROM {ORDERS}")
def reduce_python_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import functools
    import operator

    return monoids.combined(orders(spark, sf_dir), "cents", "long", lambda s: int(functools.reduce(operator.or_, s.tolist(), 0)), operator.or_, 0)
