import random

import pyarrow as pa
from helpers import documents, words

import corpus_pipeline
from sparkloom.llm import ngram_join
from sparkloom.llm.store import BATCH


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, " ".join(words(rng, 40)), "xx", rng.choice("aaaab")) for k in range(120)]
    rows += [(200, rows[0][1] + " more", "xx", "a"), (201, rows[1][1], "xx", "a"), (300, "123 456", None, "a"), (301, None, None, "b")]
    leak = " ".join(words(rng, 30))
    rows.append((400, rows[5][1] + " " + leak + " " + rows[6][1], "xx", "b"))
    bench = str(tmp_path)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(bench + "/benchmark.parquet")
    docs = documents(spark, rows)
    told = corpus_pipeline.identify_language(spark, docs, bench)
    assert told.columns == docs.columns and {r["doc_id"] for r in told.collect()} == {r[0] for r in rows} - {300, 301}
    single = corpus_pipeline.drop_near_copies(spark, told, bench)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {r[0] for r in rows} - {300, 301, 200, 201}
    clean = corpus_pipeline.drop_contaminated(spark, single, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(120))
    mixed = corpus_pipeline.mix_sources(spark, clean, bench)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(range(120)) and mixed.count() > 120
    out = corpus_pipeline.write_tokens(spark, mixed, bench)
    assert out.count() == mixed.count()
    docs.write.parquet(bench + "/documents.parquet")
    assert corpus_pipeline.run(spark, bench).count() == mixed.count()


def test_stages_name_the_operators():
    assert len(corpus_pipeline.STAGES) == 5 and ngram_join.keep_first.__name__ == "keep_first"


def test_workers_get_a_few_mb_at_a_time(spark):
    """An executor's workers and its JVM hold a batch for each task at once."""
    kind, own = "doc_id long, text string, lang string, source string", spark.conf.get(BATCH, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text", "'xx' AS lang", "'a' AS source")
    try:
        spark.conf.unset(BATCH)
        docs = corpus_pipeline.identify_language(spark, spark.createDataFrame([(1, "some words", "xx", "a")], kind), "")
        assert docs.count() == 1
        got = [r["size"] for r in rows.mapInArrow(sizes, "size long").collect()]
        assert sum(got) > 30_000_000 and max(got) < 8_000_000
        spark.conf.set(BATCH, "1m")  # a session's own size stays
        corpus_pipeline.identify_language(spark, docs, "")
        assert spark.conf.get(BATCH) in ("1m", "1048576")
    finally:
        spark.conf.unset(BATCH) if own is None else spark.conf.set(BATCH, own)
