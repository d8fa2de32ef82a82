"""Registration of queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name."""

        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, cents, price, cust, status: a sequence by o_orderkey."""
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS idx", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents", "o_totalprice AS price", "o_custkey AS cust", "o_orderstatus AS status", "o_orderpriority AS priority")


def hash_sql(*seeds: object) -> str:
    """What generators.bits gives for a portable seed."""
    return f"CAST('0x' || substr(md5(concat_ws(',', {', '.join(map(str, seeds))})), 1, 13) AS BIGINT)"


def unit_sql(*seeds: object) -> str:
    return f"(CAST({hash_sql(*seeds)} AS DOUBLE) / 4503599627370496)"


ORDERS = "(SELECT o_orderkey AS idx, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_totalprice AS price, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
