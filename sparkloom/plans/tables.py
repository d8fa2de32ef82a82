"""Tables in the shared folder: they cut the lineage of loops and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows and read them back, so that later jobs start from files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffles. Spark takes rows made by explode for no more than those before it, and would send them all through the driver."""
    return df.hint("merge")


#: Rows of one task of a plan that keeps its rows in memory, and the least that are worth a task.
MOST, LEAST = 1 << 19, 1 << 13


def pieces(spark: SparkSession, rows: int) -> int:
    """So many that each has about MOST of the rows at most, whatever the session's number of partitions."""
    return max(1, min(spark.sparkContext.defaultParallelism, rows // LEAST), -(-rows // MOST))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which has or will have about so many rows, by hashes of keys in pieces()."""
    return df.repartition(pieces(df.sparkSession, rows), *keys)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again, such as those of a loop's earlier rounds."""
    for table in tables:
        path = getattr(table, "_settled_at", None)
        if path is not None:
            _delete(table.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return
    _written.clear()
