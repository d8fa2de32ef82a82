"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text
from ..sources import generators
from .base import Registry, read, unit_sql

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_SUFFIXES = "SELECT p_partkey, pos, row_number() OVER (PARTITION BY p_partkey ORDER BY encode(substr(p_name, CAST(pos + 1 AS INT)))) - 1 AS rank, p_name FROM (SELECT p_partkey, p_name, unnest(range(strlen(p_name))) AS pos FROM part)"


@query(f"SELECT p_partkey, rank, pos FROM ({_SUFFIXES})")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.suffix_array(text.characters(read(spark, sf_dir, "part"), "p_partkey", "p_name"), "p_partkey")


@query(f"""WITH s AS ({_SUFFIXES}), t AS (SELECT p_partkey, rank, pos, substr(p_name, CAST(pos + 1 AS INT)) AS a, lead(substr(p_name, CAST(pos + 1 AS INT))) OVER (PARTITION BY p_partkey ORDER BY rank) AS b FROM s)
SELECT p_partkey, rank, pos, CASE WHEN b IS NOT NULL THEN len(list_filter(range(1, 200), lambda k: k <= least(strlen(a), strlen(b)) AND substr(a, 1, CAST(k AS INT)) = substr(b, 1, CAST(k AS INT)))) END AS lcp FROM t""")
def suffix_common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = text.characters(read(spark, sf_dir, "part"), "p_partkey", "p_name")
    return text.common_prefixes(chars, text.suffix_array(chars, "p_partkey"), "p_partkey")


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\r\\n\\x00]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.word_counts(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS whole, printf('%.11e', o_totalprice) AS real FROM orders")
def numbers_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", text.to_text(F.col("o_custkey"), "int").alias("whole"), text.to_text(F.col("o_totalprice"), "double").alias("real"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents")
def string_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each hash: the same as of each text."""
    hashed = read(spark, sf_dir, "documents").select("doc_id", text.string_hash(F.col("text")).alias("hash"))
    return hashed.join(hashed.groupBy("hash").agg(F.min("doc_id").alias("first")), "hash").select("doc_id", "first")


_TRIGRAMS = """w AS (SELECT '__' || word || '_' AS p FROM (SELECT unnest(string_split_regex(p_name, '[ \\t\\r\\n\\x00]+')) AS word FROM part) WHERE word <> ''), g AS (SELECT substr(p, CAST(i AS INT), 3) AS g FROM (SELECT p, unnest(range(1, length(p) - 1)) AS i FROM w)),
c AS (SELECT substr(g, 1, 2) AS prefix, substr(g, 3, 1) AS char, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT prefix, char, sum(n) OVER (PARTITION BY prefix ORDER BY encode(char)) / sum(n) OVER (PARTITION BY prefix) AS cum, (sum(n) OVER (PARTITION BY prefix ORDER BY encode(char)) - n) / sum(n) OVER (PARTITION BY prefix) AS low FROM c)"""


@query(f"WITH {_TRIGRAMS} SELECT prefix, char, round(cum, 9) AS cum FROM t")
def trigram_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = generators.trigram_table(text.words(read(spark, sf_dir, "part"), "p_name"))
    return found.select("prefix", "char", F.round("cum", 9).alias("cum"))


@query(f"""WITH RECURSIVE {_TRIGRAMS}, r AS (SELECT range AS idx, 0 AS k, '__' AS prefix, '' AS word, '' AS c FROM range(1000)
UNION ALL SELECT idx, k + 1, substr(r.prefix, 2, 1) || coalesce(t.char, '_'), CASE WHEN coalesce(t.char, '_') = '_' THEN word ELSE word || t.char END, coalesce(t.char, '_')
FROM (SELECT *, {unit_sql(0, 'k', 'idx')} AS u FROM r WHERE c <> '_' AND k < 100) r LEFT JOIN t ON t.prefix = r.prefix AND r.u >= low AND r.u < cum)
SELECT idx, word FROM r WHERE c = '_' OR k = 100""")
def trigram_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = generators.trigram_table(text.words(read(spark, sf_dir, "part"), "p_name"))
    return generators.trigram_words(spark, table, 1000, generators.Portable(0))
