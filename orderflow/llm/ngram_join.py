"""N-gram Jaccard join: T-occurrence search over inverted lists, with the long lists probed, as Spark jobs.

Two sets with ``100 * common >= percent * union`` share at least ``T = ceil(percent * n / 100)`` of either set's n
shingles. So a partner stands in one at least of any ``n - T + 1`` lists of a set: those are merged, and the other
``T - 1``, which are the longest, are only probed, by binary search of the two sorted sets. Which lists are long is
counted over all documents. Exact copies are one node; large groups of near copies are contracted step by step
(``common.linked_groups``), so no list is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, linked_groups

#: Shingle length in words and the least similarity in percent.
WORDS, PERCENT = 4, 85
#: A list counts as long from LONG documents; at most HOT_LISTS are told to all tasks (8 bytes each), the longest ones.
LONG, HOT_LISTS = 12, 1 << 20
#: A task counts so many list entries at a time (8 bytes each, held some four times over), so that workers stay small beside a full heap.
COUNTED = 1_000_000
#: Up to so many ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


#: Bits of a set's parity sketch, in 64-bit words: each shingle flips one bit, so sets differ in as many members at least
#: as their sketches differ in bits.
SKETCH = 4


def _short(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _node(s: np.ndarray) -> int | None:
    """Identity of a set: a 64-bit hash of its members and size."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return int(tokens.mix64(tokens.mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def _sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        yield from tokens.shingles(*tokens.words(texts), k)


def _list_lengths(k: int, percent: int):
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def out():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(values), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(values[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)])], ["key", "n"])

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                for s in _sets(part.column("text"), k):
                    if len(s):
                        held.append(s[: _short(len(s), percent)])
                        size += len(held[-1])
                if size > COUNTED:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


def _signatures(hot, k: int, percent: int):
    def run(batches):
        long_lists = hot.value
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                sizes, nodes, cold, short, sketches = [], [], [], [], []
                for s in _sets(part.column("text"), k):
                    want = _short(len(s), percent) if len(s) else 0
                    lead = s[: 2 * want]  # usually enough lists that are not long
                    is_hot = np.zeros(len(lead), bool)
                    for _ in range(2):
                        if len(long_lists) and len(lead):
                            at = np.minimum(np.searchsorted(long_lists, lead), len(long_lists) - 1)
                            is_hot = long_lists[at] == lead
                        if len(lead) == len(s) or np.count_nonzero(~is_hot) >= want:
                            break
                        lead, is_hot = s, np.zeros(len(s), bool)
                    kept = lead[~is_hot][:want]
                    sizes.append(len(s))
                    nodes.append(_node(s))
                    cold.append(len(kept))
                    sketches.append(_sketch(s))
                    short.append(np.concatenate([kept, lead[is_hot][: want - len(kept)]]).view(np.int64))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, short)]).astype(np.int32), pa.array(np.concatenate(short) if short else np.zeros(0, np.int64)))
                sketch = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sketches)), SKETCH).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(cold, pa.int32()), lists, sketch], ["doc_id", "size", "node", "cold", "lists", "sketch"])

    return run


def _named(k: int):
    """Adds each text's node."""

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                nodes = pa.array([_node(s) for s in _sets(part.column("text"), k)], pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, part.column("text")], ["node", "text"])

    return run


def _linked(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "a_text"):
                keep = []
                for x, y in zip(_sets(part.column("a_text"), k), _sets(part.column("b_text"), k)):
                    x, y = (x, y) if len(x) <= len(y) else (y, x)
                    at = np.searchsorted(y, x)
                    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def long_lists(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> np.ndarray:
    """Sorted shingle hashes whose lists are long among the first lists of all sets; bounded by HOT_LISTS."""
    counts = docs.select("text").mapInArrow(_list_lengths(k, percent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LONG)
    counts = scratch.write(counts, "long")
    least, room = LONG, HOT_LISTS
    for n, lists in counts.groupBy(F.least(F.col("n"), F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).collect():  # 65,536 rows at most
        room -= lists
        if room < 0:
            least = n + 1
            break
    keys = counts.where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy()
    scratch.drop(counts)
    return np.sort(keys.view(np.uint64))


def jaccard_groups(docs: DataFrame, scratch: Scratch, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are runs of other characters than space, tab, LF, VT, FF and CR. A set holds the distinct
    k-word shingles, or the whole sequence of fewer words. Sets link at ``percent`` or more of Jaccard similarity;
    component_id is the smallest doc_id that links reach. Shingles are compared by 64-bit hashes.

    Null, empty and wordless texts: n_shingles 0, linked with nothing, component_id is the own doc_id. Null doc_id: its
    text links as any other, but the id counts for nothing (null where the whole group has none). Repeated rows and
    repeated ids stay apart and link by their texts. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hot = spark.sparkContext.broadcast(long_lists(docs, k, percent, scratch))
    signed = scratch.write(docs.mapInArrow(_signatures(hot, k, percent), "doc_id long, size long, node long, cold int, lists array<long>, sketch array<long>"), "signed")
    named = signed.where("node is not null")
    own = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    each = named.select("node", "cold", "lists").dropDuplicates(["node"])
    posts = each.select("node", "cold", F.posexplode("lists").alias("place", "key")).select("key", "node", "place", (F.col("place") >= F.col("cold")).alias("hot"))
    facts = named.groupBy("node").agg(F.max("size").alias("size"))
    details = named.select("node", "sketch")

    def near(x: Column, y: Column) -> Column:
        """Sizes fit, and enough shingles are left from here on, if this is the first list that both are in."""
        common = F.least(x["size"] - x["place"], y["size"] - y["place"])
        sized = 100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])
        return sized & ((100 + percent) * common >= percent * (x["size"] + y["size"]))

    def close(x: Column, y: Column) -> Column:
        """Near, and no more members are known to differ than may differ."""
        differ = sum(F.bit_count(F.get(x["sketch"], F.lit(i)).bitwiseXOR(F.get(y["sketch"], F.lit(i)))) for i in range(SKETCH))
        return near(x, y) & ((100 + percent) * differ <= (100 - percent) * (x["size"] + y["size"]))

    def verify(pairs: DataFrame, room: Scratch) -> DataFrame:
        pairs = room.write(pairs, "pairs")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = room.write(nodes.join(own, "node"), "wanted")
        ids = wanted.select("doc_id").distinct()
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        found = docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi").select("text")
        texts = found.mapInArrow(_named(k), "node long, text string").join(wanted.select("node"), "node").dropDuplicates(["node"])
        texts = room.write(texts, "texts")
        for end in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"{end}_text")), end)
        return pairs.mapInArrow(_linked(k, percent), "a long, b long")

    roots = linked_groups(posts, facts, details, F.col("place"), near, close, verify, scratch)
    grouped = signed.select("doc_id", "size", "node").join(roots, "node", "left").select("doc_id", "size", F.coalesce("root", "node").alias("root"))
    grouped = scratch.write(grouped, "grouped")
    least = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = grouped.join(least, "root", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op2"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
e AS MATERIALIZED (SELECT row, doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.row <> b.row
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.row, b.row, a.doc_id, b.doc_id, a.n, b.n),
links AS MATERIALIZED (SELECT DISTINCT a, b FROM c WHERE 100 * common >= 85 * (na + nb - common)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.root)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.root AS component_id
FROM s JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = s.doc_id
"""
