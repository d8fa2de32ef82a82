"""Queries of duplicate removal, dictionaries and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets
from .base import Registry, read

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("SELECT DISTINCT l_partkey FROM lineitem")
def dedup_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_keys(read(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT DISTINCT text FROM documents")
def dedup_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_keys(read(spark, sf_dir, "documents"), "text")


@query("SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY p_brand")
def dedup_pairs_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.best_of_key(read(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedup_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_keys(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"))


@query("SELECT k, max(v) AS v FROM (SELECT l_partkey AS k, l_quantity AS v FROM lineitem UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE) FROM part) GROUP BY k")
def table_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v"))
    return sets.insert(sets.best_of_key(_parts(spark, sf_dir), "k", "v"), more, "k", "v")


@query("SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def table_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return sets.remove(sets.best_of_key(_parts(spark, sf_dir), "k", "v"), gone, "k")


@query("""WITH d AS (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1)
SELECT o_orderkey AS idx, o_custkey AS k, v FROM orders LEFT JOIN d ON k = o_custkey""")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("k"))
    return sets.dictionary(_parts(spark, sf_dir), gone, asked, "k", "v").select("idx", "k", "v")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("x")), read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("x"))


_A, _B = "SELECT o_custkey AS x FROM orders", "SELECT s_suppkey * 3 AS x FROM supplier"


@query(f"{_A} UNION {_B}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(*_two(spark, sf_dir))


@query(f"{_A} INTERSECT {_B}")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersect(*_two(spark, sf_dir))


@query(f"{_A} EXCEPT {_B}")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_two(spark, sf_dir))


@query("SELECT true AS set_same, false AS sequence_same")
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("v"))
    turned = rows.select((F.lit(rows.count() - 1) - F.col("idx")).alias("idx"), "v")
    same = sets.same_set(rows.select("v"), turned.select("v")), sets.same_sequence(rows, turned)
    return spark.range(1).select(F.lit(same[0]).alias("set_same"), F.lit(same[1]).alias("sequence_same"))


# --- joins that the other operators are made of ---------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_retailprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 20 AND s_acctbal + 20")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in ranges: both are dealt to cells as wide as a range, and cells join."""
    wide = 40.0
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / wide).alias("cell"))
    low, high = F.col("s_acctbal") - 20, F.col("s_acctbal") + 20
    ranges = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide))).alias("cell"))
    return parts.join(ranges, "cell").where(F.col("p_retailprice").between(low, high)).select("p_partkey", "s_suppkey")
