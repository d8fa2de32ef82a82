"""Tables in the shared folder that cut lineage, and small helpers for reading inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import new_path, release, settle, shared_folder

__all__ = ["fold", "free_name", "new_path", "read", "release", "settle", "shared_folder", "small_batches"]

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows go to Python workers in batches of about `size`, unless the session has a size of its own.

    Spark's 64 MB a batch stand in the JVM, there and back, and in the worker, for each task of an executor at once.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, size)


def free_name(df: DataFrame, name: str = "mark") -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(column, parts: int):
    """crc32 of the value as text, modulo `parts`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
