"""The pipeline's stages on small tables."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from orderflow.llm import decontam, ngram_join
from orderflow.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90_001, None, "en", "x", 0), (90_002, "12 34", "en", "x", 5), (90_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(more)
    seen = docs
    for name, stage in pipeline.STAGES:
        before, docs = docs, Scratch(spark, "t").write(stage(spark, docs, SF))
        if name != "source_mix":
            assert docs.columns == before.columns
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
        if name == "language_id":
            assert {r.doc_id for r in before.join(docs, "doc_id", "left_anti").collect()} == {90_001, 90_002, 90_003}
        if name == "line_dedup":
            assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
        if name == "near_duplicates":
            assert ngram_join.jaccard_groups(docs, Scratch(spark, "t")).where("component_id <> doc_id").isEmpty()
        if name == "decontamination":
            assert decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()
    assert set(docs.columns) == {"doc_id", "source", "size", "source_size", "target", "taken"} and 0 < docs.count() < seen.count()


def test_run(spark):
    assert pipeline.run(spark, SF).where("taken > 0").count() > 0


CLASH = ("lang_pred", "score", "n_lines", "n_dropped", "doc", "_id", "_key", "key", "place", "part", "node", "size")


def test_stage_edges(spark):
    """Null ids and texts, repeated rows and ids, long texts, columns that clash, empty tables."""
    learned = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").limit(120)
    long = " ".join(f"word{i}" for i in range(60_000))
    text = "the house on the hill is old and the people there are not"
    rows = [(90_001, text, "en", "x", 1), (90_002, text, "en", "x", 1), (None, text, "en", "x", 1), (90_001, "quite another text that stands under the same number here", "en", "x", 1), (90_003, long, "en", None, 1), (90_003, long, "en", None, 1), (None, None, None, None, None), (90_004, "", "en", "x", 0)]
    docs = learned.unionByName(spark.createDataFrame(rows, learned.schema)).select("*", *(F.concat(F.lit("my "), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASH))
    want = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = Scratch(spark, "t").write(stage(spark, docs, SF))
        assert out.dtypes == docs.dtypes
        assert out.where(F.concat(F.lit("my "), F.coalesce("doc_id", F.lit(-1))) != F.col("n_dropped")).isEmpty() and out.where("lang_pred <> score").isEmpty()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        mine = want(out.where("doc_id is null or doc_id > 90000"))
        if name == "language_id":
            assert mine >= {(90_001, text), (None, text)} and (None, None) not in mine
        if name == "line_dedup":
            assert mine >= {(None, text), (None, None), (90_004, "")} and not any(t == text for i, t in mine if i is not None)
        if name == "near_duplicates":
            assert out.where("doc_id is null or doc_id > 90000").count() == 5
            assert mine == {(90_001, text), (90_001, rows[3][1]), (90_003, long), (None, None), (90_004, "")}
        if name == "decontamination":
            assert out.count() >= docs.count() - 120
    assert pipeline.source_mix(spark, docs, SF).count() == docs.count() and pipeline.source_mix(spark, docs.limit(0), SF).count() == 0


def test_foreign_and_junk_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # some hundred texts to learn from
    rows = [(90_001, "\u044d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u0440\u0443\u0441\u0441\u043a\u043e\u043c " * 5, None, "x", 1), (90_002, "xqzj kkvw pqqx zzxj wvvq" * 5, None, "x", 1), (90_003, "\u3053\u306e\u30c6\u30ad\u30b9\u30c8 a", None, "x", 1)]
    out = pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    gone = {r.doc_id for r in docs.join(out, "doc_id", "left_anti").where("text rlike '[a-z]{3}' and length(text) > 40").collect()}
    assert out.where("doc_id > 90000").isEmpty() and not gone
