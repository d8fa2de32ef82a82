"""Queries of vectors, matrices and hash trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg, merkle
from ..sources import generators
from .base import Registry, read

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS dot FROM embeddings")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(linalg.dot(F.col("embedding"), F.col("embedding")), 4).alias("dot"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum("l_quantity").alias("v"))


_M = "(SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(f"SELECT r, CAST(sum(v * p_size) AS DOUBLE) AS y FROM {_M} JOIN part ON p_partkey = c GROUP BY r")
def matrix_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"), F.col("p_size").alias("x"))
    return linalg.times_vector(_matrix(spark, sf_dir), vector)


@query(f"SELECT a.r, b.r AS c, sum(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.c = b.c GROUP BY a.r, b.r")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return linalg.times(m, linalg.transpose(m))


@query(f"SELECT c AS r, r AS c, v FROM {_M}")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.transpose(_matrix(spark, sf_dir))


# Orders fall in 7 x 5 blocks by key; blocks lie in row order and are moved to column order.
@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_custkey % 7 AS r, o_orderkey % 5 AS c FROM orders), s AS (SELECT row_number() OVER (ORDER BY r, c, o_orderkey) - 1 AS idx, row_number() OVER (ORDER BY c, r, o_orderkey) - 1 AS place, o_orderkey AS v FROM o)
SELECT place AS idx, v FROM s""")
def block_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import blocks

    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), (F.col("o_custkey") % 7).alias("r"), (F.col("o_orderkey") % 5).alias("c"))
    items = blocks.dense_index(rows, "r", "c", "v")
    counts = rows.groupBy("r", "c").agg(F.count("*").alias("length"))
    sources = blocks.scan(blocks.dense_index(counts, "r", "c"), "length", "sum", 0, inclusive=False, out="start").select("r", "c", "start", "length")
    targets = blocks.scan(blocks.dense_index(counts, "c", "r"), "length", "sum", 0, inclusive=False, out="to").select("r", "c", "to")
    return linalg.block_transpose(items.select("idx", "v"), sources, targets)


def _order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block_id"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary").alias("data"))


@query("SELECT o_orderkey + (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) FROM orders) AS node_id, sha256(o_orderpriority || o_orderkey) AS digest FROM orders")
def merkle_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks_ = _order_blocks(spark, sf_dir)
    n = blocks_.count()
    first = 1 << (n - 1).bit_length()
    return merkle.tree(blocks_).where(F.col("node_id").between(first, first + n - 1)).select("node_id", F.lower(F.hex("digest")).alias("digest"))


@query("""WITH RECURSIVE w AS (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM orders), r AS (SELECT node_id, coalesce(sha256(data), sha256('')) AS digest
FROM (SELECT n + range AS node_id, range AS block_id FROM w, range((SELECT n FROM w))) LEFT JOIN (SELECT o_orderkey AS block_id, o_orderpriority || o_orderkey AS data FROM orders) USING (block_id)
UNION ALL SELECT node_id // 2, sha256(CAST(bit_or(CAST(unhex(digest) AS BIT)) AS BLOB)) FROM r WHERE node_id > 1 GROUP BY node_id // 2) SELECT * FROM r""")
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tree(_order_blocks(spark, sf_dir)).select("node_id", F.lower(F.hex("digest")).alias("digest"))


@query()
def merkle_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tree(generators.byte_blocks(spark, 16, 3000), "sha384", nested=True)
