"""What the operators of this subpackage share: scratch tables, distributed prefix sums, linked groups."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cut import shared_folder

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"
#: Nodes are not paired under a key if one of so many keys before it is common as well.
BEFORE = 4


class Scratch:
    """Tables of one run, written to the shared folder so that later steps neither repeat nor lose their work.

    ``drop`` removes a table that no live plan reads any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_folder(spark, name)
        self._n = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark._jvm
            for path in [t.scratch_path for t in tables] or [self.root]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts 0. Each word with the spaces around it becomes one letter."""
    marked = F.regexp_replace(text, f"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "x")
    return F.when(text.rlike(f"[^{SPACES}]"), F.length(marked)).otherwise(0).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str], scratch: Scratch) -> DataFrame:
    """Adds ``row_before`` and ``<value>_before``: row count and sums over all rows that come earlier in the order.

    Rows are range-partitioned, each partition sums its own rows and gets the total of the partitions before it. Only
    one row for each partition meets in a single task. Ties fall in one partition in an order that the caller fixes.
    """
    part = scratch.write(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    earlier = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(v).alias(f"_t_{v}") for v in values))
    starts = starts.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_t_{v}") for v in values))
    inside = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = part.join(F.broadcast(starts), "_pid")
    return out.select(
        *df.columns,
        (F.col("_n") + F.count(F.lit(1)).over(inside)).alias("row_before"),
        *((F.col(f"_t_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values),
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is one node of the connected group.

    Contraction rounds: each node hooks to the neighbour, or itself, with the smallest hash, edges are rewritten to
    those targets, and what has become a loop goes. Hashes change by round, so the number of nodes that are left falls
    by a constant factor even on long paths. Hubs are pre-aggregated by the minimum; every round is a written table.
    """
    left, hooks = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges"), []
    while not left.isEmpty():
        turn = F.lit(len(hooks))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("root"))).alias("m"))
        own = F.struct(F.xxhash64("node", turn).alias("h"), F.col("node").alias("root"))
        hooks.append(scratch.write(least.select("node", F.least("m", own)["root"].alias("root")), "hooks"))
        moved = left
        for end in ("a", "b"):
            moved = moved.join(hooks[-1].select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        moved = moved.where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        before, left = left, scratch.write(moved.distinct(), "edges")
        scratch.drop(before)
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0]
    for hook in hooks[1:]:
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = out.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return scratch.write(out, "roots")


def pairs_across(rows: DataFrame, close: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b), a below b: nodes of different roots that share a key and are close.

    ``rows``: key and a struct ``one`` of root, node, before0, before1, ... and what ``close`` needs. A pair comes under
    the first key that both hold, and not again where one of the BEFORE keys before it is common too.
    """
    l, r = F.col("l"), F.col("r")
    earlier = (F.coalesce(l[f"before{i}"] == r[f"before{j}"], F.lit(False)) for i in range(BEFORE) for j in range(BEFORE))
    apart = (l["node"] < r["node"]) & (l["root"] != r["root"]) & close(l, r) & ~reduce(Column.__or__, earlier)
    both = rows.withColumnRenamed("one", "l").join(rows.withColumnRenamed("one", "r"), "key").where(apart)
    return both.select(l["node"].alias("a"), r["node"].alias("b"))


def linked_groups(
    posts: DataFrame, facts: DataFrame, details: DataFrame | None, rank: Column, near: Callable[[Column, Column], Column], close: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame, Scratch], DataFrame], scratch: Scratch
) -> DataFrame:
    """(node, root) over all true links between nodes that share a key, without forming all pairs of a key's nodes.

    ``posts``: key, node, place, hot; hot is false only for keys of short lists. ``facts``: node and what
    ``rank`` and ``near`` need beside place; ``details``: node and what else ``close`` needs, if anything. ``near(l, r)`` and ``close(l, r)`` must be true for a pair that
    links under the first of its keys, by place; all nodes hold their keys in one order. ``verify`` takes distinct
    pairs (a, b), and scratch room, and returns those that are links.

    Each node is first paired with the first node of its key by rank, and what links is contracted. Then every close
    pair of nodes that share a key and are still in different groups is verified. It is formed under the first key that
    both hold, and not again where one of the BEFORE keys before it is common too: nearly once, not once for each key.
    A pair that is never formed joins nodes that are connected already or cannot link, so the groups are those of all links.
    """
    room, node = Scratch(scratch.spark, "links"), F.col("one.node")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    key = W.partitionBy("key")
    ends = (F.min("node").alias("lo"), F.max("node").alias("hi"))
    cold = posts.where("not hot").select("key", "node", "place", F.min("node").over(key).alias("lo"), F.max("node").over(key).alias("hi")).where("lo < hi")
    hot = posts.where("hot").join(posts.where("hot").groupBy("key").agg(*ends).where("lo < hi"), "key")
    shared = room.write(cold.select("key", "node", "place").unionByName(hot.select("key", "node", "place")), "shared")
    one = F.struct(rank.alias("rank"), "node", "place", *(c for c in facts.columns if c != "node"))
    ranked = room.write(shared.join(facts, "node").select("key", one.alias("one")), "ranked")
    star = ranked.join(ranked.groupBy("key").agg(F.min("one").alias("first")), "key")
    star = star.where((node != F.col("first.node")) & near(F.col("one"), F.col("first"))).select(*pair(node, F.col("first.node"))).distinct()
    star = room.write(star, "star")
    links = room.write(verify(star, room), "links")
    roots = components(links, room)

    rooted = ranked.select("key", "one", node.alias("node")).join(roots, "node", "left").select("key", "node", "one", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    order = W.partitionBy("node").orderBy("one.place", "key")
    before = [F.lag("key", i + 1).over(order).alias(f"before{i}") for i in range(BEFORE)]
    mixed = room.write(rooted.join(several, "key").select("*", *before), "mixed")
    fields = [F.col("root"), *(F.col(f"before{i}") for i in range(BEFORE)), *(F.col("one")[c].alias(c) for c in ranked.schema["one"].dataType.names)]
    if details is not None:
        more = details.join(mixed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        mixed = mixed.join(room.write(more, "details"), "node")
        fields += [F.col(c) for c in details.columns if c != "node"]
    across = pairs_across(mixed.select("key", F.struct(*fields).alias("one")), close).distinct()
    rest = room.write(verify(across.join(star, ["a", "b"], "left_anti"), room), "links")
    roots = scratch.write(roots if rest.isEmpty() else components(links.unionByName(rest), room), "roots")
    room.drop()
    return roots
