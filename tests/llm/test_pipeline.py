"""The pipeline, stage by stage, on documents whose fate is known."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.common import settle


def test_planted_cases(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [r.asDict() for r in base.where("doc_id < 120 AND length(text) BETWEEN 900 AND 4000").orderBy("doc_id").collect()]
    source = clean[0]
    extra = [source | {"doc_id": 900_001}, source | {"doc_id": 900_002, "text": source["text"] + " tail"}, source | {"doc_id": 900_003, "text": "12 34 --"}, source | {"doc_id": 900_004, "text": None}]
    item = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").first().text
    extra.append(clean[1] | {"doc_id": 900_005, "text": item})
    docs = base.where("doc_id >= 120").unionByName(spark.createDataFrame(clean + extra, base.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = settle(stage(spark, docs, "/root/testdata/sf0.01"), f"test-{name}", "zstd")
        assert docs.columns == base.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 900_003 not in kept["language_id"] and 900_004 not in kept["language_id"]
    assert 900_001 not in kept["near_dedup"] and 900_002 not in kept["near_dedup"]
    assert 900_005 in kept["near_dedup"] and 900_005 not in kept["decontamination"]
    last = corpus_pipeline.STAGES[4][1](spark, docs, "/root/testdata/sf0.01")
    assert last.count() == docs.count()


def test_nulls_repeats_and_empty_tables(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("n_words", F.lit(1))
    odd = base.where("doc_id < 60").unionByName(base.where("doc_id < 5")).unionByName(base.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(base.limit(2).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = settle(stage(spark, docs, "/root/testdata/sf0.001"), f"test-odd-{name}", "zstd")
            assert docs.columns == base.columns
        last = corpus_pipeline.STAGES[4][1](spark, docs, "/root/testdata/sf0.001")
        assert last.count() == docs.count()
