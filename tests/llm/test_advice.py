"""What the review of round 1 found missing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from orderflow.llm import decontam


def test_stage_finds_copies_with_text_appended(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:100]), " ".join(words[:122]), " ".join(words[200:300]), " ".join(words[200:330])]  # 0.81 and 0.76
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2, 3}


def test_items_in_capitals_and_with_signs(spark):
    item = "mañana el niño verá élan über años dónde está señor último día aquí también\nla respuesta será así"
    docs = [(1, item.upper()), (2, item.replace(" ", ",!! ")), (3, "¿" + item.replace(" ", " «")), (4, "nada de eso está aquí")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, items).collect()} == {1, 2, 3}
    assert [r.doc_id for r in decontam.clean(docs, items).select(F.col("doc_id")).collect()] == [4]


def test_quality_blocks_ask_under_their_own_number(monkeypatch):
    import pyarrow as pa

    from orderflow.llm import quality

    monkeypatch.setattr(quality, "HELD", 30)  # blocks are told before their partition ends
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array([f"text number {chr(97 + i)}" for i in range(12)])], ["block", "text"])
    told = {(b, k) for part in quality._asked([batch]) for b, k in zip(*(c.to_pylist() for c in part.columns))}
    assert told == {(i, int(k)) for i in range(12) for k in quality.grams(pa.array([f"text number {chr(97 + i)}"]))[0]}
    texts = pa.table({"doc_id": [1], "lang": ["en"], "trusted": [True], "text": ["text a"], "block": [0]})
    with pytest.raises(ValueError):
        quality._scored(texts, pa.table({"key": pa.array([], pa.int64()), "log_p": pa.array([], pa.float64())}))


def test_quality_gathers_more_from_more_text(spark):
    from orderflow.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    grams = lambda df: df.mapInArrow(quality._counts, "key long, c long").select("key").distinct().count()
    assert grams(docs) > 1.5 * grams(docs.where("doc_id % 5 = 0"))
