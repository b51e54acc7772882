"""Ranked lexical search: a bit-sliced index of impacts, added bit by bit and read from the highest slice down.

The corpus is cut into blocks of documents. For each term of a block the index holds, slice by slice, bitmaps of one bit of
the term's impact on each document; words of 64 documents without the term are left out. A query adds the slices of
its terms with the logic of a ripple-carry adder, 64 documents at a time, and finds its best documents by going from the most
significant slice of the sum downwards. Blocks are independent; only each task's best documents meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch

#: Documents in a block.
BLOCK = 2_048
#: Most slices of a rare term are empty; packed, a block is small wherever Spark holds many rows.
CODEC = "zstd"
#: Items whose terms are indexed and asked together, by number and by characters; more items make more passes.
ITEMS, CHARS = 10_000, 64_000_000
#: A block answers so many items at a time that their sums fit in about this many bytes.
ROOM = 16_000_000
#: Length normalisation of the impacts.
BEST, LEAST, SHARE = 10, 100, 90

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column as bytes (A-Z lower-cased) with what stands between them, so that terms have the even places; and
    where each text's terms begin, counted in terms. The bytes are not copied."""
    data, at = tokens.raw_bytes(texts)
    inside = _IS_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = inside[at[:-1][full]]
    last[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts = np.flatnonzero(first)
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, np.flatnonzero(last) + 1
    n = max(0, len(edges) - 1)
    found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(_LOWER[data])]) if n else pa.array([], pa.large_binary())
    return found, np.searchsorted(starts, at)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i] ... starts[i] + counts[i] - 1, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Asked:
    """The distinct terms of some items, and for each item its terms' numbers."""

    def __init__(self, numbers: list[int], ids: list[int | None], texts: list[str | None]):
        found, at = terms(pa.array(texts, pa.string()))
        found = found.take(pa.array(np.arange(0, len(found), 2)))
        self.terms = pc.unique(found)
        code = pc.index_in(found, value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.numbers, self.ids = numbers, pa.array(ids, pa.int64())
        self.item_terms = [np.unique(code[a:b]) for a, b in zip(at[:-1], at[1:])]


# the index


def _flush(held: list[tuple]) -> pa.RecordBatch:
    """One block: documents by ascending id, null last, and the postings of each term."""
    ids = pa.concat_arrays([h[0] for h in held])
    n, row, term, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
    null, key = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
    order = np.lexsort((key, null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[row]
    by = np.lexsort((row, term))
    row, term, tf = row[by], term[by], tf[by]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    lists = (ids.take(pa.array(order)), pa.array(n[order]), pa.array(term[first], pa.int32()), pa.array(np.diff(first, append=len(term)), pa.int64()), pa.array(row, pa.int32()), pa.array(tf, pa.int32()))
    columns = [pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x).cast(pa.list_(x.type)) for x in lists]
    return pa.RecordBatch.from_arrays([*columns, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["doc_id", "n", "term", "df", "row", "tf", "texts", "words"])


_POSTINGS = "doc_id array<long>, n array<long>, term array<int>, df array<long>, row array<int>, tf array<int>, texts long, words long"
_INDEX = "doc_id array<long>, term array<int>, cells array<long>, word array<int>, slices int, bits binary"


def postings(docs: DataFrame, asked) -> DataFrame:
    """Blocks of documents with the occurrences of the asked terms, and the number of texts with terms and of all terms."""

    def run(batches):
        held, rows = [], 0
        wanted = asked.value.terms
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                found, at = terms(part.column("text"))
                code = pc.fill_null(pc.index_in(found, value_set=wanted), -1).to_numpy(zero_copy_only=False)[::2]
                n = np.diff(at)
                hit = np.flatnonzero(code >= 0)
                pair, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * (len(wanted) + 1) + code[hit], return_counts=True)
                row, term = np.divmod(pair, len(wanted) + 1)
                for a in range(0, len(n), BLOCK):
                    lo, hi = np.searchsorted(row, (a, a + BLOCK))
                    some = part.column("doc_id").slice(a, BLOCK)
                    if held and rows + len(some) > BLOCK:
                        yield _flush(held)
                        held, rows = [], 0
                    held.append((some, n[a : a + BLOCK], row[lo:hi] - a + rows, term[lo:hi], tf[lo:hi]))
                    rows += len(some)
        if held:
            yield _flush(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


def _lists(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names]


def sliced(blocks: DataFrame, weights, texts: int, words: int) -> DataFrame:
    """The bit-sliced index of blocks: ``weights`` by term, over a corpus of ``texts`` texts with ``words`` terms."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n, term, df, row, tf = _lists(batch, i, "n", "term", "df", "row", "tf")
                m = LEAST - SHARE + SHARE * n * texts // max(1, words)
                tf = tf.astype(np.int64)
                impact = np.repeat(weights.value[term], df) * (1_000_000_000 * tf // (1_000 * tf + 8 * m[row]))
                owner = np.repeat(np.arange(len(term)), df)
                cell = owner * (len(n) // 64 + 1) + row // 64
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                impact, bit = impact.astype(np.uint64), (row % 64).astype(np.uint64)
                slices = int(impact.max()).bit_length() if len(impact) else 0
                bits = np.zeros((slices, len(first)), np.uint64)
                for s in range(slices):
                    bits[s] = np.bitwise_or.reduceat((impact >> np.uint64(s) & np.uint64(1)) << bit, first)
                cells = np.bincount(owner[first], minlength=len(term)) if len(term) else np.zeros(0, np.int64)
                lists = (batch.column("doc_id")[i].values, pa.array(term, pa.int32()), pa.array(cells, pa.int64()), pa.array(row[first] // 64, pa.int32()))
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([slices], pa.int32()), pa.array([pa.compress(bits.tobytes(), CODEC, asbytes=True)], pa.binary())], [x.split()[0] for x in _INDEX.split(", ")])

    return blocks.mapInArrow(run, _INDEX)


# the search


def add(total: np.ndarray, cell: np.ndarray, bits: np.ndarray) -> None:
    """Adds the numbers in the slices ``bits`` to those in ``total``, in the words ``cell`` (each once): sum and carry bit by bit."""
    carry = np.zeros(len(cell), np.uint64)
    for s in range(len(total)):
        if s >= len(bits) and not carry.any():
            return
        have = total[s, cell]
        half = have ^ bits[s] if s < len(bits) else have
        total[s, cell] = half ^ carry
        carry = (have & bits[s] | half & carry) if s < len(bits) else half & carry


def best(total: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query, rows and sums of the ``k`` greatest sums above 0 of each query, of equal ones the first rows; by slices [bit, query, word].

    ``sure`` holds rows among the best, ``open_`` those that equal the k-th in all bits seen so far.
    """
    open_ = np.bitwise_or.reduce(total, axis=0) if len(total) else np.zeros(total.shape[1:], np.uint64)
    sure = np.zeros_like(open_)
    for s in range(len(total) - 1, -1, -1):
        both = sure | open_ & total[s]
        n = np.bitwise_count(both).sum(axis=1)[:, None]
        sure = np.where(n <= k, both, sure)
        open_ = np.where(n > k, open_ & total[s], np.where(n < k, open_ & ~total[s], np.uint64(0)))
    rows_of = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    for q in range(total.shape[1]):
        rows = rows_of(sure[q])
        if len(rows) < k and open_[q].any():
            rows = np.concatenate([rows, rows_of(open_[q])[: k - len(rows)]])
        if len(rows):
            bits = total[:, q, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)
            yield q, rows, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def answers(block: tuple, asked: Asked, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place of an item, rows and scores of its best documents of one block."""
    n, term, cells, word, bits = block
    first = np.cumsum(cells) - cells
    width = n // 64 + 1
    for start, stop in _groups(asked.item_terms, len(bits), width):
        some = asked.item_terms[start:stop]
        depth = len(bits) + max([len(t) for t in some], default=0).bit_length()
        total = np.zeros((depth, len(some) * width), np.uint64)
        q, code = np.repeat(np.arange(len(some)), [len(t) for t in some]), np.concatenate([*some, np.zeros(0, np.int64)]).astype(np.int64)
        place = np.minimum(np.searchsorted(term, code), max(0, len(term) - 1))
        here = (term[place] == code) if len(term) else np.zeros(len(code), bool)
        q, place = q[here], place[here]
        turn = np.arange(len(q)) - np.searchsorted(q, q)  # the n-th term of its item that the block holds
        for t in range(int(turn.max()) + 1 if len(turn) else 0):
            now = turn == t
            at = expand(first[place[now]], cells[place[now]])
            add(total, np.repeat(q[now], cells[place[now]]) * width + word[at], bits[:, at])
        for i, rows, score in best(total.reshape(depth, len(some), width), k):
            yield start + i, rows, score


def _groups(item_terms: list[np.ndarray], slices: int, width: int) -> Iterator[tuple[int, int]]:
    size = max(1, ROOM // (8 * (slices + 8) * width))
    for start in range(0, len(item_terms), size):
        yield start, min(start + size, len(item_terms))


def search(index: DataFrame, asked, k: int) -> DataFrame:
    """item, item_id, doc_id, score: each task's ``k`` best documents of each item at most."""

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_id")[i].values
                null, key = pc.is_null(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                term, cells, word = _lists(batch, i, "term", "cells", "word")
                slices = batch.column("slices")[i].as_py()
                bits = pa.decompress(batch.column("bits")[i].as_buffer(), 8 * slices * len(word), CODEC)
                bits = np.frombuffer(bits, np.uint64).reshape(slices, len(word))
                new = [(np.full(len(rows), item), score, null[rows], key[rows]) for item, rows, score in answers((len(ids), term, cells, word, bits), asked.value, k)]
                held = [np.concatenate([h, *x]) for h, x in zip(held, zip(*new))] if new else held
                order = np.lexsort((held[3], held[2], -held[1], held[0]))
                held = [h[order] for h in held]
                keep = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                held = [h[keep] for h in held]
        item, score, null, key = held
        out = [pa.array(np.array(asked.value.numbers, np.int64)[item]), asked.value.ids.take(pa.array(item)), pa.array(key, mask=null.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(out, ["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10, most: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) its ``k`` best documents (doc_id, text).

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased, of whole texts. All
    counts are over all documents. Scores are whole numbers, as the sum of the impacts of an item's distinct terms;
    only scores above 0 come, equal ones by ascending doc_id.

    Null, empty and wordless texts have no terms: such items get no rows, such documents do not count. Null doc_id: a
    document like others, after all ids where scores tie. Repeated rows of documents are documents of their own.
    Repeated rows of items are answered each on their own, also where they share an item_id, null or not. Empty tables give no rows. Other columns
    are not read. Texts of any length are read as a whole, one document's terms at a time where it is long.

    About ``most`` items are asked in one pass over the corpus; each pass indexes the terms of its items.
    """
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("item"))
    own = scratch.write(own.where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")), "items")
    n, chars = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(-(-n // most), -(-chars // CHARS))
    out = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for shard in range(shards):
        held = own.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).orderBy("item").collect()  # bounded by ITEMS and CHARS
        asked = spark.sparkContext.broadcast(Asked([r["item"] for r in held], [r["item_id"] for r in held], [r["text"] for r in held]))
        blocks = scratch.write(postings(docs, asked), "postings")
        texts, words = (x or 0 for x in blocks.agg(F.sum("texts"), F.sum("words")).first())
        df = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df")).toPandas()  # a row for each asked term
        weights = np.zeros(len(asked.value.terms) + 1, np.int64)
        weights[df["term"].to_numpy(np.int64)] = np.floor(1_000 * np.log((2 * texts + 2) / (2 * df["df"].to_numpy(np.int64) + 1)))
        index = scratch.write(sliced(blocks, spark.sparkContext.broadcast(weights), texts, words), "index")
        scratch.drop(blocks)
        out = out.unionByName(search(index, asked, k)) if shard else search(index, asked, k)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op11"))


OP11_SQL = r"""
WITH words AS (SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY r, term),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS texts, sum(n)::BIGINT AS words FROM len),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * texts + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * texts) // words))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
