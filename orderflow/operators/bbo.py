"""Best bid and offer after every message: folded in slices of a symbol's history, or joined from intervals without a fold."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cut import cut

#: A symbol's changes are cut into slices of about so many, which are folded in parallel.
SLICE = 50_000


class _Side:
    """Best price of a changing set of levels: a heap whose stale entries are skipped."""

    def __init__(self, way: int):
        self.way, self.size, self.heap = way, {}, []

    def set(self, price: int, size: int, orders: int) -> None:
        if orders <= 0:
            self.size.pop(price, None)
        else:
            if price not in self.size:
                heapq.heappush(self.heap, self.way * price)
            self.size[price] = size

    def best(self) -> tuple:
        while self.heap and self.way * self.heap[0] not in self.size:
            heapq.heappop(self.heap)
        return (self.way * self.heap[0], self.size[self.way * self.heap[0]]) if self.heap else (None, None)


def timeline(history: DataFrame, width: int = SLICE) -> DataFrame:
    """seq, symbol_idx, bid_price, bid_size, ask_price, ask_size: a row for each message that changes them.

    ``history`` has a row for each change of a level, valid until next_seq. Most symbols are one slice. One with more than
    ``width`` changes is cut between buckets of ``width`` sequence numbers, where its changes before add up to ``width``
    again. A slice begins with the levels that are valid at its edge, so slices need not wait for each other. A task
    streams through its slices in order.
    """
    history = cut(history.select("seq", "symbol_idx", "side", "price", "agg_size", "num_orders", "next_seq"))
    bucket = F.floor(F.col("seq") / width)
    counts = history.groupBy(F.col("symbol_idx").alias("_symbol"), bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("_symbol").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    cuts = counts.withColumn("_slice", F.floor(F.sum("n").over(before) / width)).where("_slice > 0").drop("n")
    after = cuts.select(F.col("_symbol").alias("_symbol2"), F.col("_bucket").alias("_bucket2"), F.col("_slice").alias("_slice2"))
    ends = cuts.groupBy(F.col("_symbol").alias("_symbol3")).agg(F.max("_slice").alias("_end"))
    rows = history.withColumn("bucket", bucket).withColumn("next_bucket", F.floor(F.col("next_seq") / width))
    rows = rows.join(cuts, (F.col("symbol_idx") == F.col("_symbol")) & (F.col("bucket") == F.col("_bucket")), "left")
    changes = rows.select("symbol_idx", F.coalesce("_slice", F.lit(0)).alias("slice"), "seq", "side", "price", "agg_size", "num_orders", "next_bucket", "next_seq")
    # levels of symbols with several slices that last into later ones
    held = changes.where("num_orders > 0").join(ends, F.col("symbol_idx") == F.col("_symbol3"))
    held = held.join(after, (F.col("symbol_idx") == F.col("_symbol2")) & (F.col("next_bucket") == F.col("_bucket2")), "left")
    last = F.when(F.col("next_seq").isNull(), F.col("_end")).otherwise(F.coalesce("_slice2", F.lit(0)))
    held = held.withColumn("to", last).where("to > slice")
    held = held.select("symbol_idx", F.explode(F.sequence(F.col("slice") + 1, F.col("to"))).alias("slice"), F.lit(-1).cast("long").alias("seq"), "side", "price", "agg_size", "num_orders")
    names = ["symbol_idx", "slice", "seq", "side", "price", "agg_size", "num_orders"]
    ordered = changes.select(names).unionByName(held.select(names)).repartition("symbol_idx", "slice").sortWithinPartitions("symbol_idx", "slice", "seq")

    def fold(batches):
        where, at, sides, shown, out = None, None, {}, None, []

        def close():
            """The row of the message that is complete, if it changed anything; levels from before a slice tell nothing."""
            nonlocal shown
            now = sides["B"].best() + sides["S"].best()
            if at >= 0 and now != shown:
                out.append((at, where[0], *now))
            shown = now

        for pdf in batches:
            for symbol, part, seq, side, price, size, orders in zip(*(pdf[n].tolist() for n in names)):
                if (symbol, part) != where or seq != at:
                    if where is not None:
                        close()
                    if (symbol, part) != where:
                        where, sides, shown = (symbol, part), {"B": _Side(-1), "S": _Side(1)}, (None,) * 4
                    at = seq
                sides[side].set(price, size, orders)
            yield _frame(out)
            out = []
        if where is not None:
            close()
            yield _frame(out)

    return ordered.mapInPandas(fold, "seq long, symbol_idx int, bid_price long, bid_size long, ask_price long, ask_size long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["seq", "symbol_idx", "bid_price", "bid_size", "ask_price", "ask_size"]).astype({c: "Int64" for c in ("bid_price", "bid_size", "ask_price", "ask_size")})


def timeline_by_nodes(history: DataFrame) -> DataFrame:
    """The rows of ``timeline`` from joins and aggregates alone: no fold, no order of work within a symbol.

    The interval of seq in which a level has its size is split into dyadic nodes (runs of 2^k numbers that begin at a multiple of it), two
    for each k at most. A node keeps the best price of those that cover it. A point of time lies in one node for each k, so the best price
    then is the best of log2(n) nodes, found by one equi-join. Each message asks for its own seq and the number before, and makes a row
    where the two differ. A node is one row, so a node that many messages ask for is a skewed join with one row on the other side.
    """
    top = max(1, int(history.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]).bit_length() + 1)
    key = F.col("price") * F.when(F.col("side") == "B", -1).otherwise(1)
    held = history.where("num_orders > 0").select("symbol_idx", "side", F.struct(key.alias("key"), "price", "agg_size").alias("best"), F.col("seq").alias("a"), F.coalesce("next_seq", F.lit(1 << top)).alias("b"))
    # at size 2^k the whole nodes inside [a, b) are those from ceil(a / 2^k) to floor(b / 2^k); only an odd end is no part of a larger one
    ends = "transform(sequence(0, {k}), k -> struct(k, shiftright(a + shiftleft(1L, k) - 1, k) AS lo, shiftright(b, k) AS hi))"
    nodes = "flatten(transform(filter(ends, e -> e.lo < e.hi), e -> array(struct(e.k, e.lo AS i, e.lo % 2 = 1 AS odd), struct(e.k, e.hi - 1 AS i, e.hi % 2 = 1 AS odd))))"
    split = held.withColumn("ends", F.expr(ends.format(k=top))).select("symbol_idx", "side", "best", F.explode(F.expr(f"filter({nodes}, n -> n.odd)")).alias("n"))
    best = split.groupBy("symbol_idx", "side", "n.k", "n.i").agg(F.min("best").alias("best"))

    # a number and the one before it lie in the same node for most k, which is then asked for once
    now = f"transform(sequence(0, {top}), k -> struct(k, shiftright(seq, k) AS i, true AS at, seq > 0 AND shiftright(seq, k) = shiftright(seq - 1, k) AS before))"
    was = f"transform(filter(sequence(0, {top}), k -> seq > 0 AND shiftright(seq, k) <> shiftright(seq - 1, k)), k -> struct(k, shiftright(seq - 1, k) AS i, false AS at, true AS before))"
    points = history.select("symbol_idx", "seq").distinct().select("symbol_idx", "seq", F.explode(F.expr(f"concat({now}, {was})")).alias("n")).select("symbol_idx", "seq", "n.*")
    side = lambda asks, s: F.min(F.when(F.col(asks) & (F.col("side") == s), F.col("best")))
    # nodes are many times the history that their size is estimated from, and must not be broadcast
    found = points.join(best.hint("merge"), ["symbol_idx", "k", "i"]).groupBy("symbol_idx", "seq").agg(side("at", "B").alias("bid"), side("at", "S").alias("ask"), side("before", "B").alias("was_bid"), side("before", "S").alias("was_ask"))
    changed = found.where(~(F.col("bid").eqNullSafe(F.col("was_bid")) & F.col("ask").eqNullSafe(F.col("was_ask"))))
    return changed.select("seq", "symbol_idx", F.col("bid.price").alias("bid_price"), F.col("bid.agg_size").alias("bid_size"), F.col("ask.price").alias("ask_price"), F.col("ask.agg_size").alias("ask_size"))
