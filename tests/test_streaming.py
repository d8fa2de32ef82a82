from pyspark.sql import functions as F

from sparkloom.streaming import tables


def stream(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], "k int, v int, at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k int, v int, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.col("at").cast("timestamp"))


def test_keyed_tables_over_a_stream(spark, tmp_path):
    from datetime import datetime

    t = datetime(2026, 1, 1)
    rows = [(1, 5, t), (2, 3, t), (1, 9, t), (3, 1, t), (2, 2, t), (3, 1, t), (1, 7, t)]
    tables.to_memory(tables.best_of_key(stream(spark, tmp_path, rows), "k", "v"), "best", "complete")
    assert {r["k"]: r["v"] for r in spark.table("best").collect()} == {1: 9, 2: 3, 3: 1}
    tables.to_memory(tables.reduce(stream(spark, tmp_path / "b", rows), F.col("v"), "sum"), "total", "complete")
    assert spark.table("total").first()["v"] == sum(r[1] for r in rows)
    tables.to_memory(tables.distinct_keys(stream(spark, tmp_path / "c", rows), "k", at="at"), "once", "append")
    assert sorted(r["k"] for r in spark.table("once").collect()) == [1, 2, 3]
