"""Language ID: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its 1- to 3-byte grams (lower-cased UTF-8), hashed to DIM places, and the kernel of two texts is
``|x & y| / sqrt(|x| |y|)``. Landmark texts span the feature space; ridge regression there gives one function for each
language. As the kernel is a dot product of presence vectors, the products with the landmarks and with the weights
are multiplied out once, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens

GRAMS, DIM = 3, 1 << 14
#: The model is fitted on at most PER_LANG texts of a language and TRAIN in all, those with the smallest hashes of ids, or of texts without an id.
PER_LANG, TRAIN, LANDMARKS, RIDGE = 500, 6_000, 400, 1.0
UNKNOWN = "und"


def presence(texts: pa.Array) -> np.ndarray:
    """A row of DIM flags for each text."""
    data, at = tokens.raw_bytes(texts)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64) * DIM, np.diff(at))
    flags = np.zeros(len(texts) * DIM, np.uint8)
    code = data.astype(np.uint32)
    for n in range(1, GRAMS + 1):
        if n > 1:
            code = code[:-1] * np.uint32(256) + data[n - 1 :]
        place = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(18)
        inside = rows[: len(place)]
        keep = inside == rows[n - 1 :] if n > 1 else slice(None)
        flags[(inside + place)[keep]] = 1
    return flags.reshape(len(texts), DIM)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Classifier:
    """Languages, weights (DIM x languages) and biases."""

    def __init__(self, flags: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 5):
        self.langs = sorted(set(langs))
        scale = 1 / np.sqrt(np.maximum(1, flags.sum(axis=1, dtype=np.int64)))
        unit = lambda rows: flags[rows] * scale[rows, None]  # noqa: E731  a few rows at a time: they are much larger so
        marks = unit(np.random.default_rng(seed).permutation(len(flags))[:landmarks])
        near = np.vstack([unit(np.arange(i, min(i + 256, len(flags)))) @ marks.T for i in range(0, len(flags), 256)])
        values, vectors = np.linalg.eigh(marks @ marks.T)
        kept = values > 1e-8 * max(values.max(), 1e-12)
        root = vectors[:, kept] / np.sqrt(values[kept])
        phi = np.hstack([near @ root, np.ones((len(near), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        fit = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]) * np.append(np.ones(phi.shape[1] - 1), 1e-6), phi.T @ y)
        self.weights = (marks.T @ (root @ fit[:-1])).astype(np.float32)
        self.bias = fit[-1]

    def scores(self, flags: np.ndarray) -> np.ndarray:
        return (flags.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(1, flags.sum(axis=1, keepdims=True, dtype=np.int64))) + self.bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, total: int = TRAIN) -> Classifier | None:
    """Learns from the distinct texts of (doc_id, text, lang) that are not held out; None where there is nothing to learn from."""
    labelled = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")) & ~held_out(F.col("doc_id")))
    # drawn by id, and rows without one by text
    draw = lambda seed: F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("text", F.lit(seed)))
    labelled = labelled.select("lang", F.lower("text").alias("text"), draw(11).alias("drawn"), draw(12).alias("h"), F.xxhash64("text").alias("key"))
    # fractions for the most frequent languages; with more than `total` of them the rest have too few texts to fit
    counts = labelled.select("lang", "h", "key").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total).collect()
    each = max(1, min(per_lang, total // max(1, len(counts))))
    if not counts:
        return None
    wanted = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.3 * each / r["count"] + 1e-9)) for r in counts], "lang string, share double")
    drawn = labelled.join(F.broadcast(wanted), "lang").where(F.pmod("drawn", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    # some 1.3 times ``each`` distinct texts of a language are left where ids differ, of which those with the smallest hashes go on
    drawn = drawn.groupBy("lang", "h", "key").agg(F.min("text").alias("text"))
    drawn = drawn.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h", "key"))).where(F.col("nth") <= each)

    def flags(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                bits = np.packbits(presence(part.column("text")), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "h", "bits"])

    table = drawn.select("lang", "h", "text").mapInArrow(flags, "lang string, h long, bits binary").toPandas().sort_values(["lang", "h", "bits"])  # ``total`` rows at most
    if table.empty:
        return None
    flat = np.unpackbits(np.frombuffer(b"".join(table["bits"]), np.uint8)).reshape(len(table), DIM)
    return Classifier(flat, table["lang"].tolist())


def predict(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """Adds lang_pred and score to all columns of ``docs``, which has text (see ``identify`` for the cases)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Language and score of lower-cased texts with a letter, and null for the null of others."""
        model = known.value
        langs = np.array([*model.langs, UNKNOWN])
        for texts in batches:
            found, best = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in tokens.slices(pa.RecordBatch.from_arrays([texts], ["low"]), "low", 1 << 20):
                for i in range(0, part.num_rows, 128):
                    scores = model.scores(presence(part.column("low").slice(i, 128)))
                    found.append(scores.argmax(axis=1))
                    best.append(scores.max(axis=1))
            letter = texts.is_valid().to_numpy(zero_copy_only=False)
            pred = langs[np.where(letter, np.concatenate(found), len(model.langs))]
            score = np.where(letter, np.clip((1 + np.concatenate(best)) / 2, 0, 1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(pred.tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"])

    # Python gets the text alone: the other columns, of any size, wait in Spark. What reads the result does not run it twice
    judge = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    low = F.when(has_letter(F.col("text")), F.lower("text"))
    out = docs.select(F.struct(*names).alias("doc"), judge(low).alias("found"))
    return out.select(*(F.col("doc")[c].alias(c) for c in names), "found.lang_pred", "found.score")


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows with a lang whose crc32(doc_id) mod 5 is not 0; only the text enters a prediction. score is 0 to 1,
    0.5 where the ridge function of the best language is 0. Whole texts count.

    Null text or a text without a letter, and all texts where nothing can be learned: ``und``, 0. Null lang: predicted
    all the same, not learned from. Null doc_id: not held out, learned from like others. Ties: the language that
    is first by code point. Repeated rows come out alike, and copies under one id are learned from once; rows of one id are drawn together. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
