"""A corpus pipeline of five stages; each works on what the one before has kept.

All stages take documents (doc_id, text, lang, source, ...) and, but for the last, return their columns as they are, also
those that share a name with a column of an operator. Repeated rows are rows like others where nothing else is said, an
empty table stays empty, and texts of any length are read as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import decontam, langid, linededup, mixing, ngram_join
from orderflow.llm.common import Scratch

#: A text that is like no learned language is no further from the least possible score than this part of the way to 1.
LEAST_CONFIDENCE = 0.14
#: Near-duplicates share this percentage of their runs of so many words; op2's own pair is its contract, not the stage's.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _whole(docs: DataFrame, *more: str) -> DataFrame:
    """Every row as one column, beside the columns that an operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *more)


def _rows(docs: DataFrame, whole: DataFrame, **changed: Column) -> DataFrame:
    return whole.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the corpus itself teaches; others go.

    Null texts and texts without a letter go, and so does all where no language can be learned. Null doc_id, lang or
    source: judged by the text alike.
    """
    model = langid.fit(docs)
    out = langid.predict(_whole(docs, "text"), model)
    least = 1 / max(1, len(model.langs)) if model else 1.0
    sure = F.lit(len(model.langs) < 2 if model else False) | (F.col("score") >= least + LEAST_CONFIDENCE * (1 - least))
    return _rows(docs, out.where((F.col("lang_pred") != langid.UNKNOWN) & sure))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; documents of which nothing is left go. n_chars follows the text.

    Null and empty texts stay as they are. Rows without doc_id come first in the order of occurrence.
    """
    out = linededup.dedup_lines(_whole(docs, "doc_id", "text"), Scratch(spark, "lines"))
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("doc.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return _rows(docs, out, **changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, rows without an id last.

    Groups are those of texts, so rows that share a doc_id but no text stay apart, copies without an id go as others do,
    and of rows that repeat id and text one stays. Texts without words stay.
    """
    scratch, key = Scratch(spark, "near"), F.xxhash64("text")
    texts = docs.select(key.alias("doc_id"), "text")
    groups = ngram_join.jaccard_groups(texts, scratch, k=NEAR_WORDS, percent=NEAR_PERCENT).where("n_shingles > 0")
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("part")).distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    rows = docs.select("doc_id", key.alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).join(groups, "key")
    rows = scratch.write(rows.select("part", place.alias("place"), "n"), "members")
    several = rows.groupBy("part").agg(F.min("place").alias("first"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    marked = rows.join(several, "part")
    marked = scratch.write(marked.select(F.col("place.doc_id").alias("_id"), F.col("place.key").alias("_key"), (F.col("place") == F.col("first")).alias("_stays"), F.col("n").alias("_n")).where("not _stays or _n > 1"), "marked")
    marks = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    whole = _whole(docs, F.col("doc_id").alias("_doc_id"), key.alias("_text_key"))
    found = whole.join(marks, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    kept = _rows(docs, found.where("_stays is null"))
    again = found.where("_stays").dropDuplicates(["_doc_id", "_text_key"])
    return kept if marked.where("_stays").isEmpty() else kept.unionByName(_rows(docs, again))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and wordless texts hold none and stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes: a row for each, of null and empty texts none."""
    return mixing.mix(docs, Scratch(spark, "mix"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]
#: Language ID, SimHash and BM25 have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
