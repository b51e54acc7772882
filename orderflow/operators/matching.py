"""Matching: sweeps of aggressors over resting orders in price-then-time order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import LEVEL
from .levels import BOOK, best_first
from .lifecycle import identities

#: Cumulative volume is cut into buckets of so many shares, so that the interval join has one more key.
BUCKET = 2_000
#: Numbers of seq whose aggressors are added up in one task.
SPAN = 65_536


def queue(orders: DataFrame) -> DataFrame:
    """Adds lo and hi: the volume of a side before an order, and with it.

    Volume adds up over the levels of a side, and within each level over its orders, so no window holds a side's orders.
    """
    better = W.partitionBy("_symbol", "_side").orderBy(best_first(F.col("_price"), F.col("_side"))).rowsBetween(W.unboundedPreceding, -1)
    levels = orders.groupBy(F.col("symbol_idx").alias("_symbol"), F.col("side").alias("_side"), F.col("price").alias("_price")).agg(F.sum("size").alias("_size"))
    levels = levels.select("_symbol", "_side", "_price", F.coalesce(F.sum("_size").over(better), F.lit(0)).alias("_better"))
    inside = F.sum("size").over(W.partitionBy(*LEVEL).orderBy("priority_seq").rowsBetween(W.unboundedPreceding, 0))
    out = orders.withColumn("_inside", inside).join(levels, (F.col("symbol_idx") == F.col("_symbol")) & (F.col("side") == F.col("_side")) & (F.col("price") == F.col("_price")))
    return out.select(*orders.columns, (F.col("_better") + F.col("_inside")).alias("hi")).withColumn("lo", F.col("hi") - F.col("size"))


def sweep(orders: DataFrame, quantity: int) -> DataFrame:
    """Fills of one aggressor of ``quantity`` on every side of every symbol."""
    fill = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(quantity) - F.col("lo")))
    return queue(orders).select(*BOOK, "price", "order_id", fill.alias("fill_size"), (F.col("size") - fill).alias("resting_left")).where("fill_size > 0")


def sweep_many(orders: DataFrame, aggressors: DataFrame, bucket: int = BUCKET, span: int = SPAN) -> DataFrame:
    """Fills of many aggressors over a resting book: the overlaps of their and the orders' volume intervals.

    Both sides are cut at multiples of ``bucket``; an overlap is counted in the bucket where it begins, so the join is
    an equi-join on symbol, side and bucket, and a busy symbol is spread over its volume. Aggressors are added up in spans of
    seq, and only the totals of spans meet by symbol and side.
    """
    own = aggressors.withColumn("_span", F.floor(F.col("seq") / span))
    totals = own.groupBy(*BOOK, "_span").agg(F.sum("quantity").alias("_total"))
    earlier = W.partitionBy(*BOOK).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*BOOK, "_span", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    turn = W.partitionBy(*BOOK, "_span").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    taker = own.join(before, [*BOOK, "_span"]).withColumn("a_hi", F.col("_before") + F.sum("quantity").over(turn)).withColumn("a_lo", F.col("a_hi") - F.col("quantity"))
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket))).alias("bucket")
    left = queue(orders).where("size > 0").select(*BOOK, "price", "order_id", "size", "lo", "hi", cut("lo", "hi"))
    right = taker.where("quantity > 0").select(*BOOK, "seq", "a_lo", "a_hi", cut("a_lo", "a_hi"))
    first, last = F.greatest("lo", "a_lo"), F.least("hi", "a_hi")
    both = left.join(right, [*BOOK, "bucket"]).where((first < last) & (F.floor(first / bucket) == F.col("bucket")))
    return both.select(F.col("seq").alias("aggressor_seq"), *BOOK, "price", "order_id", (last - first).alias("fill_size"), (F.col("hi") - last).alias("resting_left"))


class Book:
    """One symbol's resting orders by side and price, each level in the order of priority; sweeps take the best levels."""

    def __init__(self):
        self.orders: dict[int, list] = {}  # id -> [side, price, size]
        self.levels: dict[str, dict[int, dict[int, None]]] = {"B": {}, "S": {}}
        self.prices: dict[str, list[int]] = {"B": [], "S": []}  # heaps; bids are negative, empty levels go when met

    def add(self, oid: int, side: str, price: int, size: int) -> None:
        if size <= 0:
            return
        self.orders[oid] = [side, price, size]
        if price not in self.levels[side]:
            self.levels[side][price] = {}
            heapq.heappush(self.prices[side], -price if side == "B" else price)
        self.levels[side][price][oid] = None

    def remove(self, oid: int) -> None:
        side, price, _ = self.orders.pop(oid)
        del self.levels[side][price][oid]

    def apply(self, kind: str, oid: int, new_oid: int | None, side: str, price: int, size: int, reset: bool) -> None:
        if kind == "A":
            return self.add(oid, side, price, size)
        if oid not in self.orders:  # unknown, stale or dead
            return None
        side, old, left = self.orders[oid]
        if kind == "R":
            self.remove(oid)
            return self.add(new_oid, side, price, size)
        if kind == "M" and (reset or price != old):
            self.remove(oid)
            return self.add(oid, side, price, size)
        left = size if kind == "M" else left - size if kind in "CE" else 0
        if left <= 0:
            return self.remove(oid)
        self.orders[oid][2] = left
        return None

    def sweep(self, side: str, quantity: int) -> Iterator[tuple[int, int, int, int]]:
        """Fills (order, price, fill, left) on resting orders of ``side``."""
        heap, levels = self.prices[side], self.levels[side]
        while heap and quantity > 0:
            price = -heap[0] if side == "B" else heap[0]
            while levels[price] and quantity > 0:
                oid = next(iter(levels[price]))
                fill = min(quantity, self.orders[oid][2])
                quantity -= fill
                self.orders[oid][2] -= fill
                left = self.orders[oid][2]
                if not left:
                    self.remove(oid)
                yield oid, price, fill, left
            if not levels[price]:
                del levels[price]
                heapq.heappop(heap)


def sweep_interleaved(flow: DataFrame) -> DataFrame:
    """Fills of aggressors (msg_type X: symbol_idx, side swept, size) that meet the book of their moment.

    Messages other than A and X need no symbol: it is that of the order that they name, through all its ids. An A of an id
    that is there already and an R that lost its id or takes one that is there are left out first; the rest is told by
    what lives. Each fill depends on all before it, so a symbol is folded in order; a task streams its symbols.
    """
    names = ["symbol_idx", "seq", "msg_type", "order_id", "new_order_id", "side", "price", "size", "priority_reset"]
    named = identities(flow.where("msg_type <> 'X'")).where("(msg_type <> 'A' or first_add) and (msg_type <> 'R' or chosen)")
    homes = named.where("msg_type = 'A'").select(F.col("line_id").alias("_line"), F.col("chain").alias("_chain"), F.col("symbol_idx").alias("_symbol"))
    named = named.join(homes, (F.col("line_id") == F.col("_line")) & (F.col("chain") == F.col("_chain"))).withColumn("symbol_idx", F.col("_symbol"))
    rows = named.select(*names).unionByName(flow.where("msg_type = 'X'").select(*names))

    def fold(batches):
        symbol, book = None, Book()
        for pdf in batches:
            out = []
            for idx, seq, kind, oid, new, side, price, size, reset in pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False):
                if idx != symbol:
                    symbol, book = idx, Book()
                if kind == "X":
                    out += [(seq, idx, side, p, o, f, r) for o, p, f, r in book.sweep(side, size)]
                else:
                    book.apply(kind, oid, new, side, price, size, reset)
            yield pd.DataFrame(out, columns=["aggressor_seq", "symbol_idx", "side", "price", "order_id", "fill_size", "resting_left"])

    ordered = rows.repartition("symbol_idx").sortWithinPartitions("symbol_idx", "seq")
    return ordered.mapInPandas(fold, "aggressor_seq long, symbol_idx int, side string, price long, order_id long, fill_size long, resting_left long")
