"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, joined to the corpus in shards.

Text is read as bytes in 64 classes (letters without case, separators, digits, the bytes of other scripts), and the
model is over ORDER of them. Counts, contexts and probabilities are tables keyed by gram, and all lookups are joins.
Documents are dealt into blocks; a block asks for each of its grams once, and is scored when the answers come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch

ORDER, WIDTH = 5, 6
#: A text passes if its log perplexity is at most that of this share of its language's trusted texts that the model has not
#: learned from (one in FOLD, by a hash of the id), plus SLACK.
QUANTILE, SLACK, FOLD = 0.99, 0.1, 5
#: Bytes of text in a block, and the most partitions that blocks are dealt to.
BLOCK_BYTES, PARTITIONS = 32_000_000, 20_000
BROADCAST_IDS = 2_000_000

_CLASS = np.full(256, 31, np.uint32)
_CLASS[[*range(ord("a"), ord("z") + 1)]] = _CLASS[[*range(ord("A"), ord("Z") + 1)]] = np.arange(26)
_CLASS[ord(" ")], _CLASS[ord("\n")], _CLASS[ord(".")], _CLASS[ord(",")] = 26, 27, 28, 29
_CLASS[ord("0") : ord("9") + 1] = 30
_CLASS[128:] = 32 + np.arange(128) % 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams within texts, and the number of the text of each."""
    data, at = tokens.raw_bytes(texts)
    symbols = _CLASS[data]
    n = max(0, len(symbols) - ORDER + 1)
    keys = np.zeros(n, np.int64)
    for j in range(ORDER):
        keys = (keys << WIDTH) | symbols[j : j + n]
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    inside = text[:n] == text[ORDER - 1 :] if n else np.zeros(0, bool)
    return keys[inside], text[:n][inside]


def _rows(*columns: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)].astype(np.int64)) for c in columns], names)


#: Grams that a task holds before it adds them up.
HELD = 4_000_000


def _distinct(parts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.unique(np.concatenate(parts))]


def _counts(batches):
    held, n = [], 0

    def told():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from _rows(keys, counts, names=["key", "c"])

    for batch in batches:
        for part in tokens.slices(batch, "text"):
            held.append(grams(part.column("text"))[0])
            n += len(held[-1])
            if n > HELD:
                yield from told()
                held, n = [], 0
    if held:
        yield from told()


def _asked(batches):
    """Each block's distinct grams; some may be told twice."""
    seen: dict[int, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks):
            for part in tokens.slices(batch.filter(pa.array(blocks == block)), "text"):
                mine = seen.setdefault(int(block), [])
                mine.append(np.unique(grams(part.column("text"))[0]))
                size += len(mine[-1])
            if size > HELD:
                for block_no in seen:
                    seen[block_no] = _distinct(seen[block_no])
                size = sum(len(x[0]) for x in seen.values())
                if size > HELD // 2:  # blocks are few in a partition; what is told twice is only looked up twice
                    for block_no, keys in seen.items():
                        yield from _told(keys[0], block_no)
                    seen, size = {}, 0
    for block_no, keys in seen.items():
        yield from _told(_distinct(keys)[0], block_no)


def _told(keys: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    yield from _rows(np.full(len(keys), block), keys, names=["block", "key"])


def _scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
    known, log_p = answers.column("key").to_numpy(), answers.column("log_p").to_numpy()
    order = np.argsort(known)
    known, log_p = known[order], log_p[order]
    ids, n, sums = [], [], []
    for batch in texts.to_batches():
        for part in tokens.slices(batch, "text"):
            keys, text = grams(part.column("text"))
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            if len(keys) and (not len(known) or (known[at] != keys).any()):
                raise ValueError("a gram of a block has no answer")
            ids.append(part.select(["doc_id", "lang", "trusted"]))
            n.append(np.bincount(text, minlength=part.num_rows))
            sums.append(np.bincount(text, log_p[at] if len(keys) else None, part.num_rows))
    if not ids:
        return pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "trusted": pa.array([], pa.bool_()), "grams": pa.array([], pa.int64()), "log_p": pa.array([], pa.float64())})
    return pa.Table.from_batches(ids).append_column("grams", pa.array(np.concatenate(n))).append_column("log_p", pa.array(np.concatenate(sums).astype(float)))


def kneser_ney(counts: DataFrame, asked: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(key, log_p) for each key of ``asked``: log probability of a gram's last symbol after the others.

    Highest order: counts. Lower orders: number of distinct symbols before the gram. Each order discounts by 1, 2 or 3
    and more occurrences, with discounts from its counts of counts, and gives what it takes to the next lower order;
    the lowest is interpolated with the uniform distribution. A context that was not seen leaves all to the lower order.
    """
    low = lambda c, n: c.bitwiseAND(F.lit((1 << (WIDTH * n)) - 1).cast("long"))
    table = counts
    out = scratch.write(asked.select("key").distinct(), "asked").withColumn("p", F.lit(None).cast("double")).withColumn("left", F.lit(1.0))
    p, left = F.lit(0.0), F.lit(1.0)
    out = out.select("key", p.alias("p"), left.alias("left"))
    for n in range(order, 0, -1):
        table = scratch.write(table, f"order{n}")
        n1, n2, n3, n4 = (x or 0 for x in table.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [max(0.1, min(i - 0.0, i - (i + 1) * y * b / a)) if a and b else 0.75 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = lambda c: F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])  # noqa: B023, E731
        context = F.shiftright("key", WIDTH)
        around = table.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(cut(F.col("c"))).alias("taken"))
        mine = table.select(F.col("key").alias("gram"), (F.col("c") - cut(F.col("c"))).alias("own"))
        out = out.withColumn("gram", low(F.col("key"), n)).withColumn("context", F.shiftright("gram", WIDTH))
        out = out.join(around, "context", "left").join(mine, "gram", "left")
        known = F.col("total").isNotNull()
        out = out.select("key", F.when(known, F.col("p") + F.col("left") * F.coalesce("own", F.lit(0.0)) / F.col("total")).otherwise(F.col("p")).alias("p"), F.when(known, F.col("left") * F.col("taken") / F.col("total")).otherwise(F.col("left")).alias("left"))
        table = table.groupBy(low(F.col("key"), n - 1).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    return scratch.write(out.select("key", F.log(F.col("p") + F.col("left") / (1 << WIDTH)).alias("log_p")), "answers")


def limits(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(lang, most): greatest log perplexity that passes, from a histogram in steps of a thousandth.

    A language all of whose trusted texts were learned from is measured by these.
    """
    rows = scored.where("trusted and log_perplexity is not null")
    fresh = rows.groupBy("lang").agg(F.max("held").alias("_any")).withColumnRenamed("lang", "_lang")  # a row for each language
    rows = rows.join(F.broadcast(fresh), F.col("lang").eqNullSafe(F.col("_lang"))).where("held or not _any")
    bins = rows.groupBy("lang", F.floor(F.col("log_perplexity") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lang = W.partitionBy("lang")  # at most some thousand bins each
    bins = bins.withColumn("upto", F.sum("n").over(lang.orderBy("bin"))).withColumn("all", F.sum("n").over(lang))
    return bins.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(((F.min("bin") + 1) / 1000 + slack).alias("most"))


def judge(docs: DataFrame, trusted_ids: DataFrame, scratch: Scratch, fold: int = FOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, lang, grams, perplexity, limit, keep.

    The model is trained on the texts whose doc_id is in ``trusted_ids``, but for one in ``fold`` (0: none), by which the
    limits of the languages are set. perplexity is per gram of the whole text. A text above its limit is not kept.

    Null texts and texts of fewer than ORDER bytes: perplexity null, not kept. Null lang: a language of its own. A
    language without trusted text has no limit, and its texts are kept. Null doc_id: never trusted, judged like others.
    Repeated rows are judged each, and train each. No trusted text: all perplexities are 64, limits null. An empty table
    gives no rows. Other columns are not read.
    """
    ids = scratch.write(trusted_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(), "trusted")
    ids = F.broadcast(ids.withColumn("_in", F.lit(True))) if ids.count() <= BROADCAST_IDS else ids.withColumn("_in", F.lit(True))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    blocks = int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1
    block: Column = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")  # rows of one id, or of none, are dealt out
    base = base.join(ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.coalesce("_in", F.lit(False)).alias("trusted"), block.alias("block"))
    dealt = base.repartition(min(4 * blocks, PARTITIONS), "block")  # so that few blocks meet in a task

    held = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(fold)) == 0 if fold else F.lit(False)
    counts = base.where(F.col("trusted") & ~held).select("text").mapInArrow(_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    asked = scratch.write(dealt.select("block", "text").mapInArrow(_asked, "block long, key long"), "keys")
    answers = kneser_ney(counts, asked, scratch)
    told = asked.join(answers, "key").select("block", "key", "log_p")
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, a: _scored(t, a), "doc_id long, lang string, trusted boolean, grams long, log_p double")
    scored = scratch.write(scored.select("doc_id", "lang", "trusted", F.coalesce(held, F.lit(False)).alias("held"), "grams", F.when(F.col("grams") > 0, -F.col("log_p") / F.col("grams")).alias("log_perplexity")), "scored")
    most = F.broadcast(limits(scored).withColumnRenamed("lang", "_lang"))
    out = scored.join(most, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    keep = F.col("log_perplexity").isNotNull() & (F.col("most").isNull() | (F.col("log_perplexity") <= F.col("most")))
    return out.select("doc_id", "lang", "grams", F.exp("log_perplexity").alias("perplexity"), F.exp("most").alias("limit"), keep.alias("keep"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1"), Scratch(spark, "op6"))
