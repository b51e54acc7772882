"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: A leaf holds some LEAF rows, as long as the sample can tell leaves apart (10 levels).
LEAF = 1_000
#: Trees are fitted on at most SAMPLE vectors (those with the smallest hashes of their ids); every row is indexed.
TREES, SAMPLE = 2, 20_000
#: A query searches leaves until they hold a share of the table's rows, a row counting once for each tree. The share is the
#: one at which PROBES of the sample find RECALL of their neighbours in the sample: vectors in clusters need a small one,
#: vectors without need most of the table. A share of as many as there are trees searches everything.
RECALL, PROBES = 0.96, 200
#: Rows are dealt by id into SHELVES shelves, queries into blocks of some QUERIES. A task streams a shelf's rows past a
#: block of queries, ROWS of them at a time, and keeps the best only: what it puts out follows the queries, not the rows.
SHELVES, ROWS, QUERIES = 8, 4_000, 4_000
NEIGHBOURS = 20


class Forest:
    """Random orthogonal directions, one for each level of each tree, and the median along it for each node."""

    def __init__(self, sample: np.ndarray, dim: int, depth: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.axes = rng.normal(size=(trees, depth, dim))
        self.axes /= np.linalg.norm(self.axes, axis=2, keepdims=True)
        self.cut = np.zeros((trees, 2**depth))  # node i of a level l stands at 2**l + i
        for t in range(trees):
            at = np.zeros(len(sample), int)
            for level in range(depth):
                along = sample @ self.axes[t, level]
                for node in range(2**level):
                    inside = along[at == node]
                    self.cut[t, 2**level + node] = np.median(inside) if len(inside) else 0.0
                at = at * 2 + (along > self.cut[t, 2**level + at])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree; leaves are numbered through all trees."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            for level in range(self.depth):
                out[:, t] = out[:, t] * 2 + (x @ self.axes[t, level] > self.cut[t, 2**level + out[:, t]])
        return out + np.arange(self.trees) * 2**self.depth

    def search(self, x: np.ndarray, rows: np.ndarray, enough: float) -> list[int]:
        """Leaves for one query, nearest first: one queue over the nodes of all trees, by the least margin so far."""
        along = self.axes @ x
        queue, found = [(-np.inf, t, 0, 0) for t in range(self.trees)], []
        while queue and enough > 0:
            far, t, level, node = heapq.heappop(queue)
            if level == self.depth:
                found.append(t * 2**self.depth + node)
                enough -= rows[found[-1]]
                continue
            margin = along[t, level] - self.cut[t, 2**level + node]
            heapq.heappush(queue, (max(far, margin), t, level + 1, 2 * node))
            heapq.heappush(queue, (max(far, -margin), t, level + 1, 2 * node + 1))
        return found


    def budget(self, x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, recall: float = RECALL) -> float:
        """Share of rows to search: of (placed) ``x``, whose rows ``own`` are the ``queries``, for a recall of the k nearest."""
        leaf = self.leaves(x)
        rows, needed = np.bincount(leaf.ravel(), minlength=self.trees * 2**self.depth), []
        for q, i in zip(queries, own):
            score = x @ q
            score[i] = -np.inf
            near = np.argsort(-score)[:k]
            order = np.array(self.search(q, rows, np.inf))
            before = np.zeros(len(rows))
            before[order] = np.cumsum(rows[order]) - rows[order]
            needed.append(before[leaf[near]].min(axis=1))
        return float((np.quantile(np.concatenate(needed), recall) + 1) / len(x)) if needed else 1.0


def place(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component, so that all have the same length: inner products order like distances."""
    return np.hstack([x, np.sqrt(np.maximum(0, norm**2 - (x * x).sum(axis=1)))[:, None]])


def aim(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries on the same sphere; only their direction counts."""
    return np.hstack([x * (norm / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class Block:
    """A block of queries and the best that each has met so far."""

    def __init__(self, queries: pd.DataFrame, leaves: int, k: int):
        queries = queries.iloc[np.argsort([f[0] if len(f) else -1 for f in queries["leaves"]], kind="stable")]
        self.ids, self.x, self.k = queries["id"].to_numpy(), _matrix(queries["vec"]), k
        self.wanted = np.zeros((len(queries), leaves), bool)
        for wanted, found in zip(self.wanted, queries["leaves"]):
            wanted[np.asarray(found, int)] = True
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)

    def meet(self, rows: pd.DataFrame) -> None:
        """By matrix product first, then exactly, ties to the smaller id. A query meets the rows that share a leaf with it."""
        x, ids, leaves = _matrix(rows["vec"]), rows["id"].to_numpy(), np.stack(rows["leaves"].to_numpy())
        for start in range(0, len(self.ids), 256):
            wanted = self.wanted[start : start + 256]
            shared = np.logical_or.reduce([wanted[:, leaf] for leaf in leaves.T])
            shared &= ids != self.ids[start : start + 256, None]
            some = np.flatnonzero(shared.any(axis=0))
            if len(some) == 0:
                continue
            scores = np.where(shared[:, some], self.x[start : start + 256] @ x[some].T, -np.inf)
            least = np.partition(scores, len(some) - self.k, axis=1)[:, len(some) - self.k] if len(some) > self.k else np.full(len(scores), -np.inf)
            for i, s in enumerate(scores):
                known, old = self.best[start + i]
                floor = max(least[i], old[-1] if len(old) == self.k else -np.inf)
                near = some[(s >= floor - 1e-9 * max(1.0, abs(floor) if np.isfinite(floor) else 1.0)) & (s > -np.inf)]
                if len(near):
                    exact = np.concatenate([old, np.cumsum(x[near] * self.x[start + i], axis=1)[:, -1]])
                    both = np.concatenate([known, ids[near]])
                    order = np.lexsort((both, -exact))[: self.k]
                    self.best[start + i] = both[order], exact[order]

    def table(self) -> pd.DataFrame:
        n = [len(ids) for ids, _ in self.best]
        ids, scores = (np.concatenate(c) for c in zip(*self.best))
        return pd.DataFrame({"query_id": np.repeat(self.ids, n), "vec_id": ids, "score": scores})


def nearest(vectors: DataFrame, scratch: Scratch, every: int = 20, k: int = NEIGHBOURS, share: float | None = None, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id of ``vectors`` (vec_id, embedding) divisible by ``every`` its k nearest.

    ``share`` of the rows are searched for a query; without it, as many as the sample needs for a recall of RECALL.
    Nearness is the inner product in double precision, summed from the first component on; ties go to the smaller
    vec_id. A query's own id is no candidate. With fewer candidates than k all come.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of
    another length than the most frequent one (of equally frequent ones the longest). Repeated ids: each row is a
    candidate once for each different vector; for a query the vector that sorts first counts. An empty table gives no
    rows. Other columns are not read. Equal vectors fall in one leaf; rows are dealt to tasks by id, so that no leaf is one task.
    """
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.exists(v, lambda x: x != 0)
    clean = vectors.where(sound).select(F.col("vec_id").cast("long").alias("id"), v.alias("vec"))
    common = clean.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = common["dim"]
    clean = clean.where(F.size("vec") == dim)
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    depth = min(max(4, int(np.ceil(np.log2(max(1, common["count"] / LEAF))))), 10)
    some = _matrix(sample["vec"])
    norm = float(np.linalg.norm(some, axis=1).max())
    placed = place(some, norm)
    forest = Forest(placed, dim + 1, depth, trees)
    if share is None:
        own = np.arange(min(PROBES, len(some)))
        share = forest.budget(placed, aim(some[own], norm), own, k)

    def index(batches):
        for pdf in batches:
            if len(pdf):
                leaves = forest.leaves(place(_matrix(pdf["vec"]), norm))
                yield pdf.assign(leaves=list(leaves))

    kind = clean.schema["vec"].dataType.simpleString()
    indexed = scratch.write(clean.dropDuplicates(["id", "vec"]).mapInPandas(index, f"id long, vec {kind}, leaves array<long>"), "index")
    held = {r["leaf"]: r["count"] for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}  # one row for each leaf of the forest
    rows = np.array([held.get(i, 0) for i in range(trees * 2**depth)])
    enough = share * rows.sum() / trees

    def probe(batches):
        for pdf in batches:
            yield pdf.assign(leaves=[forest.search(x, rows, enough) for x in aim(_matrix(pdf["vec"]), norm)] if len(pdf) else [])

    asked = clean.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    probes = scratch.write(asked.mapInPandas(probe, f"id long, vec {kind}, leaves array<long>"), "probes")
    blocks = max(1, -(-probes.count() // QUERIES))

    def every_one(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asking = probes.select(every_one(SHELVES).alias("shelf"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "vec", "leaves")
    asked_of = indexed.select(F.pmod(F.xxhash64("id"), F.lit(SHELVES)).cast("int").alias("shelf"), every_one(blocks).alias("block"), F.lit(1).alias("kind"), "id", "vec", "leaves")
    dealt = asking.unionByName(asked_of).repartition("shelf", "block").sortWithinPartitions("shelf", "block", "kind", F.col("leaves")[0])

    def compare(batches):
        at, queries, block = None, [], None
        for pdf in batches:
            for (*key, kind), part in pdf.groupby(["shelf", "block", "kind"]):
                if key != at:
                    if block:
                        yield block.table()
                    at, queries, block = key, [], None
                if kind == 0:  # a block's queries come before its rows
                    queries.append(part)
                    continue
                block = block or (Block(pd.concat(queries), len(rows), k) if queries else None)
                for i in range(0, len(part) if block else 0, ROWS):
                    block.meet(part.iloc[i : i + ROWS])
        if block:
            yield block.table()

    found = dealt.mapInPandas(compare, "query_id long, vec_id long, score double").distinct()
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", best.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op9"))
