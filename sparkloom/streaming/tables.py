"""Keyed tables over streams. Only operators whose result does not depend on the order of arrival are offered; scans, sorts and graphs need whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.blocks import MONOIDS


def reduce(stream: DataFrame, value: Column, monoid: str) -> DataFrame:
    """The combination of all rows so far; write it in complete mode."""
    return stream.agg(MONOIDS[monoid][0](value).alias("v"))


def best_of_key(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest value of each key so far; state is a row a key. Write it in update or complete mode."""
    return stream.groupBy(key).agg(F.max(value).alias(value))


def distinct_keys(stream: DataFrame, *key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the time that rows may be late; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def to_memory(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Run what is there now to completion into a table in memory: for tests and small looks."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
