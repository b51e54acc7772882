"""Mixing of sources to target weights: hash-random order, distributed prefix sums, an exact cut for each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prefix_sums, word_count

#: Weights by the order of sources, repeating; the mix takes SHARE of all words, and a source at most MOST of its own.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words to take of each source: source, source_size, source_before, target.

    ``sizes`` has source and size. Targets are ``min(most * source_size, weight * level)``, and level is the one at
    which they sum to ``share`` of all words: sources are sorted by the level at which they fill up, so prefix sums of
    limits and weights give the level in one pass, for any number of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(per, [F.col("source").asc_nulls_last()], ["source_size"], scratch)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("row_before") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.col("source_size_before").alias("source_before"), weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    ranked = ranked.withColumn("full_at", F.col("limit") / F.col("weight"))
    ranked = prefix_sums(ranked, [F.col("full_at"), F.col("source").asc_nulls_last()], ["limit", "weight"], scratch)
    ranked = scratch.write(ranked, "ranked")
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, weighs = share * (total[0] or 0), total[1] or 0.0
    full = F.col("full_at") <= (F.lit(goal) - F.col("limit_before")) / (F.lit(weighs) - F.col("weight_before"))
    spent = ranked.where(full).agg(F.sum("limit"), F.sum("weight")).first()
    rest = weighs - (spent[1] or 0.0)
    level = (goal - (spent[0] or 0.0)) / rest if rest else 0.0
    return ranked.select("source", "source_size", "source_before", F.when(full, F.col("limit")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    Within a source, documents stand in the order of a hash of their id. Whole epochs are taken first, then documents
    from the front until the budget, which is the target rounded to a word, is used up to the word: the document at
    the cut gives its first words only. ``taken`` counts repeated words again.

    Null text or a text without words: size 0, taken 0. Null source: a source of its own, the last. Null doc_id: hashed
    as the empty text. Repeated rows count each time and stand next to each other. An empty table gives no rows. Other
    columns are not read. A source that holds most rows is spread over many ranges, as the order within it is random.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sizes = scratch.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    targets = scratch.write(source_targets(sizes, scratch, weights, share, most), "targets")
    rows = prefix_sums(sizes, [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")], ["size"], scratch)
    rows = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("size_before") - F.col("source_before"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op3_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op3"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM f
      WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, full_at <= (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - cap_before) / ((SELECT sum(weight) FROM w) - weight_before) AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (is_full), 0)) / (sum(weight) - coalesce(sum(weight) FILTER (is_full), 0)) FROM g) END AS target FROM g),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken FROM e
"""
