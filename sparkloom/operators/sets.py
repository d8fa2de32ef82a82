"""Duplicate removal, dictionaries and ordered sets as keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key).distinct()


def best_of_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Of each key the greatest value."""
    return df.groupBy(key).agg(F.max(value).alias(value))


def insert(table: DataFrame, more: DataFrame, key: str, value: str) -> DataFrame:
    """A table with a row a key; of an old and a new value the greater stays."""
    return best_of_key(table.select(key, value).unionByName(more.select(key, value)), key, value)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def find(table: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """asked with the table's value, null where the key is missing."""
    return asked.join(table, key, "left")


def dictionary(inserts: DataFrame, removes: DataFrame, finds: DataFrame, key: str, value: str) -> DataFrame:
    """Insert all (greatest value wins), then remove all, then look up each `finds` row."""
    return find(remove(best_of_key(inserts, key, value), removes, key), finds, key)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def same_sequence(a: DataFrame, b: DataFrame, idx: str = "idx") -> bool:
    """The same rows at the same positions."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()
