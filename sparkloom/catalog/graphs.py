"""Queries of the graph operators: a bipartite graph of suppliers and parts, and a sparse graph of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.generators import Portable
from .base import Registry, read, unit_sql

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_BIPARTITE = "SELECT DISTINCT l_suppkey AS u, l_partkey + 10000000 AS v FROM lineitem"
_BOTH = f"(SELECT u, v FROM ({_BIPARTITE}) UNION SELECT v, u FROM ({_BIPARTITE}))"
# Each customer is joined to two others; eid is dense in order of (u, v).
_SPARSE = """(SELECT row_number() OVER (ORDER BY u, v) - 1 AS eid, u, v, CAST((u * 7919 + v * 104729) % 1009 AS DOUBLE) AS weight FROM (
  SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT c_custkey AS a, (c_custkey * 31 + 7) % (SELECT max(c_custkey) + 1 FROM customer) AS b FROM customer
  UNION ALL SELECT c_custkey, (c_custkey * 17 + 3) % (SELECT max(c_custkey) + 1 FROM customer) FROM customer) WHERE a <> b))"""


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge a line item; graph.symmetric() takes each once."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 10000000).alias("v"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    n = people.agg((F.max("a") + 1).alias("n")).first()["n"]
    pairs = people.select("a", ((F.col("a") * 31 + 7) % n).alias("b")).union(people.select("a", ((F.col("a") * 17 + 3) % n)))
    return graph.edge_array(pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).withColumn("weight", ((F.col("u") * 7919 + F.col("v") * 104729) % 1009).cast("double"))


@query(f"""WITH RECURSIVE e AS {_BOTH}, r(vertex, distance) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT v, distance + 1 FROM r JOIN e ON u = vertex WHERE distance < 8)
SELECT vertex, min(distance) AS distance FROM r GROUP BY vertex""")
def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(graph.symmetric(bipartite(spark, sf_dir)), 1)[0].select("vertex", "distance")


@query(f"""WITH RECURSIVE e AS {_BOTH}, r(vertex, distance) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT v, distance + 1 FROM r JOIN e ON u = vertex WHERE distance < 8), d AS (SELECT vertex, min(distance) AS distance FROM r GROUP BY vertex)
SELECT count(*) AS visited, max(distance) + 1 AS rounds FROM d""")
def breadth_first_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    visited, rounds = graph.bfs(graph.symmetric(bipartite(spark, sf_dir)), 1)
    return visited.agg(F.count("*").alias("visited")).select("visited", F.lit(rounds).alias("rounds"))


@query(f"""WITH RECURSIVE e AS {_SPARSE}, nb AS (SELECT x, list(y) AS l FROM (SELECT v AS x, u AS y FROM e UNION ALL SELECT u, v FROM e) GROUP BY x), vs AS (SELECT x, coalesce(l, []) AS l, row_number() OVER (ORDER BY x) AS i FROM nb),
s(i, chosen) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT vs.i, CASE WHEN list_has_any(chosen, vs.l) THEN chosen ELSE list_append(chosen, vs.x) END FROM s JOIN vs ON vs.i = s.i + 1)
SELECT unnest(chosen) AS vertex FROM (SELECT chosen FROM s ORDER BY i DESC LIMIT 1)""")
def maximal_independent_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = sparse(spark, sf_dir)
    return graph.independent_set(edges, graph.vertices_of(edges))


@query(f"""WITH RECURSIVE e AS {_SPARSE}, s(eid, used, chosen) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
SELECT e.eid, CASE WHEN list_has_any(used, [u, v]) THEN used ELSE list_concat(used, [u, v]) END, CASE WHEN list_has_any(used, [u, v]) THEN chosen ELSE list_append(chosen, e.eid) END FROM s JOIN e ON e.eid = s.eid + 1)
SELECT unnest(chosen) AS eid FROM (SELECT chosen FROM s ORDER BY eid DESC LIMIT 1)""")
def maximal_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matching(sparse(spark, sf_dir))


def _kruskal(order: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT eid, u, v, row_number() OVER (ORDER BY {order}) AS k FROM {_SPARSE}), s(k, label, chosen) AS (SELECT CAST(0 AS BIGINT), (SELECT list(range ORDER BY range) FROM range((SELECT max(c_custkey) + 1 FROM customer))), CAST([] AS BIGINT[]) UNION ALL
SELECT e.k, CASE WHEN label[u + 1] = label[v + 1] THEN label ELSE list_transform(label, lambda x: CASE WHEN x = label[v + 1] THEN label[u + 1] ELSE x END) END, CASE WHEN label[u + 1] = label[v + 1] THEN chosen ELSE list_append(chosen, e.eid) END FROM s JOIN e ON e.k = s.k + 1)
SELECT unnest(chosen) AS eid FROM (SELECT chosen FROM s ORDER BY k DESC LIMIT 1)"""


@query(_kruskal("weight, eid"))
def minimum_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.minimum_forest(sparse(spark, sf_dir))


@query(_kruskal("eid"))
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.spanning_forest(sparse(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS (SELECT u, v FROM {_SPARSE} UNION ALL SELECT v, u FROM {_SPARSE}), r(vertex, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, root FROM r JOIN e ON e.u = vertex WHERE root < e.v)
SELECT vertex, min(root) AS root FROM r GROUP BY vertex""")
def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(sparse(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY u, v) - 1 AS eid, u, v FROM ({_BIPARTITE})")
def edge_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_array(graph.symmetric(bipartite(spark, sf_dir)))


@query(f"SELECT eid, u, v, {unit_sql(0, 'eid')} AS weight FROM (SELECT row_number() OVER (ORDER BY u, v) - 1 AS eid, u, v FROM ({_BIPARTITE}))")
def weighted_edge_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted_edge_array(graph.symmetric(bipartite(spark, sf_dir)), Portable(0))


@query(f"SELECT u, count(*) AS degree FROM {_BOTH} GROUP BY u")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.symmetric(bipartite(spark, sf_dir)))


@query(f"SELECT u AS vertex, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS neighbours FROM {_BOTH} GROUP BY u")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(spark, graph.symmetric(bipartite(spark, sf_dir))).withColumn("neighbours", F.array_join("neighbours", ","))
