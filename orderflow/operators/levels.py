"""Price levels: building, history, ranking, depth, keyed upsert and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import in_bounds, page, sign, slot
from ..schemas import LEVEL

BOOK = ("symbol_idx", "side")


def build(orders: DataFrame) -> DataFrame:
    """Levels of resting orders; partial sums before the shuffle keep a hot level cheap."""
    return orders.groupBy(*LEVEL).agg(F.sum("size").alias("agg_size"), F.count(F.lit(1)).alias("num_orders"))


def snapshot(deltas: DataFrame, seq: int | None = None) -> DataFrame:
    """Levels with an order as of message ``seq`` (the last one where it is None)."""
    rows = deltas if seq is None else deltas.where(F.col("seq") <= seq)
    return rows.groupBy(*LEVEL).agg(F.sum("d_size").alias("agg_size"), F.sum("d_orders").alias("num_orders"), F.max("seq").alias("last_seq")).where("num_orders > 0")


def history(deltas: DataFrame) -> DataFrame:
    """Size and order count of a level after each change, and the next change's seq."""
    level = W.partitionBy(*LEVEL).orderBy("seq")
    upto = level.rowsBetween(W.unboundedPreceding, 0)
    return deltas.select("seq", "feed_time", *LEVEL, F.sum("d_size").over(upto).alias("agg_size"), F.sum("d_orders").over(upto).alias("num_orders"), F.lead("seq").over(level).alias("next_seq"))


def stamps(levels: DataFrame) -> DataFrame:
    """Adds created_seq and created_feed_time (since the level was last empty) to ``history``."""
    level = W.partitionBy(*LEVEL).orderBy("seq")
    born = (F.col("num_orders") > 0) & (F.coalesce(F.lag("num_orders").over(level), F.lit(0)) == 0)
    life = levels.withColumn("born", born.cast("int")).withColumn("life", F.sum("born").over(level.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*LEVEL, "life").orderBy("seq")
    created = {"created_seq": F.first("seq").over(inside), "created_feed_time": F.first("feed_time").over(inside)}
    return life.withColumns(created).drop("born", "life")


def best_first(price: Column, side: Column) -> Column:
    """Sort key: bids high to low, asks low to high."""
    return price * -sign(side)


def ranked(levels: DataFrame) -> DataFrame:
    """Adds idx, 0 for the best level of a side."""
    return levels.withColumn("idx", F.row_number().over(W.partitionBy(*BOOK).orderBy(best_first(F.col("price"), F.col("side")))) - 1)


def top(levels: DataFrame, k: int = 3) -> DataFrame:
    """The k best levels of each side; the filter on the rank lets Spark drop others before the shuffle."""
    return ranked(levels).where(F.col("idx") < k)


def level_at(levels: DataFrame, n: int) -> DataFrame:
    return ranked(levels).where(F.col("idx") == n)


def next_level(levels: DataFrame) -> DataFrame:
    """Adds next_price, further from the best price (null at the end), and gap."""
    after = F.lead("price").over(W.partitionBy(*BOOK).orderBy(best_first(F.col("price"), F.col("side"))))
    return levels.withColumn("next_price", after).withColumn("gap", F.abs(F.col("next_price") - F.col("price")))


def find(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Left join of (symbol_idx, side, price, ...) with ranked levels: idx is null where there is no such level."""
    return wanted.join(ranked(levels).select(*LEVEL, "idx", "agg_size"), list(LEVEL), "left")


def best_bid_offer(levels: DataFrame) -> DataFrame:
    bid, ask = F.col("side") == "B", F.col("side") == "S"
    at = F.struct("price", "agg_size")
    best = levels.groupBy("symbol_idx").agg(F.max(F.when(bid, at)).alias("bid"), F.min(F.when(ask, at)).alias("ask"))
    return best.select("symbol_idx", F.col("bid.price").alias("bid_price"), F.col("bid.agg_size").alias("bid_size"), F.col("ask.price").alias("ask_price"), F.col("ask.agg_size").alias("ask_size"))


def total_shares(levels: DataFrame) -> DataFrame:
    return levels.groupBy(*BOOK).agg(F.sum("agg_size").alias("shares"))


def level_count(levels: DataFrame, securities: DataFrame) -> DataFrame:
    """Number of levels of every security, and whether its book is empty."""
    n = levels.groupBy("symbol_idx").agg(F.count(F.lit(1)).alias("n"))
    return securities.select("symbol_idx").join(n, "symbol_idx", "left").select("symbol_idx", F.coalesce("n", F.lit(0)).alias("levels"), F.col("n").isNull().alias("empty"))


def volume_vector(levels: DataFrame) -> DataFrame:
    """Sizes of a side's levels from the best price on, as an array."""
    pair = F.struct(best_first(F.col("price"), F.col("side")).alias("key"), "agg_size")
    return levels.groupBy(*BOOK).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["agg_size"]).alias("volumes"))


def band_depth(orders: DataFrame, price: str, min_tick: int = 0) -> DataFrame:
    """Depth of each ladder page of 1,024 ticks, and how many of its slots are in use."""
    rows = orders.withColumn("page", page(F.col(price), min_tick)).withColumn("slot", slot(F.col(price), min_tick))
    slots = rows.groupBy(*BOOK, "page", "slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("orders"))
    return slots.groupBy(*BOOK, "page").agg(F.sum("size").alias("agg_size"), F.sum("orders").alias("num_orders"), F.count(F.lit(1)).alias("slots"))


def price_bounds(orders: DataFrame, price: str, min_tick: int, max_tick: int) -> DataFrame:
    """Adds reason: price_bounds where the ladder has no slot for the price, else null."""
    return orders.withColumn("reason", F.when(~in_bounds(F.col(price), min_tick, max_tick), "price_bounds"))


def queue_position(orders: DataFrame) -> DataFrame:
    """Place in the queue of a level by priority_seq, from 1, and the size ahead."""
    queue = W.partitionBy(*LEVEL).orderBy("priority_seq")
    ahead = F.coalesce(F.sum("size").over(queue.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return orders.select(*LEVEL, "order_id", "size", F.row_number().over(queue).alias("position"), ahead.alias("size_ahead"))


def queue_timeline(states: DataFrame, width: int = 65_536) -> DataFrame:
    """Place of an order in its level's queue, and the size ahead, after each of its own messages: seq, order_id, LEVEL, size, position, size_ahead.

    ``states`` are those of lifecycle.order_states. Ahead are the orders of the level with an earlier priority_seq that live at that seq: a sum over
    all changes with both an earlier priority and no later seq. Priorities before p are log2(p) dyadic nodes at most, and in each
    node a running sum over seq tells what is there. Running sums are cut at multiples of ``width`` numbers, whose totals are carried,
    so a level that holds a third of all orders is many tasks.
    """
    chain = W.partitionBy("line_id", "chain").orderBy("seq")
    ok = states.where("reason is null").withColumn("was_priority", F.lag("priority_seq").over(chain))
    top = max(1, int(ok.agg(F.coalesce(F.max("priority_seq"), F.lit(0))).first()[0]).bit_length())
    left = F.struct(F.col("was_price").alias("price"), F.col("was_priority").alias("priority"), F.when(F.col("was_rem") > 0, -1).otherwise(0).alias("n"), (-F.col("was_rem")).alias("s"))
    joined = F.struct("price", F.col("priority_seq").alias("priority"), F.when(F.col("rem") > 0, 1).otherwise(0).alias("n"), F.col("rem").alias("s"))
    moves = ok.select("seq", "symbol_idx", "side", F.explode(F.array(left, joined)).alias("m")).select("seq", "symbol_idx", "side", "m.*").where("s <> 0")
    moves = moves.groupBy("seq", *LEVEL, "priority").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # a node that stands for the priorities before p has an even number
    nodes = F.expr(f"filter(transform(sequence(0, {top}), k -> struct(k, shiftright(priority, k) AS i)), x -> x.i % 2 = 0)")
    asked_nodes = F.expr(f"transform(filter(sequence(0, {top}), k -> shiftright(priority_seq, k) % 2 = 1), k -> struct(k, shiftright(priority_seq, k) - 1 AS i))")
    bucket = F.floor(F.col("seq") / width).alias("bucket")
    moved = moves.select(*LEVEL, "seq", bucket, F.explode(nodes).alias("x"), "n", "s", F.lit(None).cast("long").alias("asked"))
    live = ok.where("rem > 0").select("seq", F.when(F.col("msg_type") == "R", F.col("new_order_id")).otherwise(F.col("order_id")).alias("order_id"), *LEVEL, F.col("rem").alias("size"), "priority_seq")
    asks = live.select(*LEVEL, "seq", bucket, F.explode(asked_nodes).alias("x"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"), F.col("seq").alias("asked"))
    node = [*LEVEL, "k", "i"]
    both = moved.unionByName(asks).select(*LEVEL, "x.k", "x.i", "bucket", "seq", "n", "s", "asked")
    upto = W.partitionBy(*node, "bucket").orderBy("seq")  # with all of the same seq
    inside = both.withColumns({"n": F.sum("n").over(upto), "s": F.sum("s").over(upto)}).where("asked is not null")
    earlier = W.partitionBy(*node).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    totals = both.groupBy(*node, "bucket").agg(F.sum("n").alias("n0"), F.sum("s").alias("s0"))
    carried = totals.withColumns({"n0": F.sum("n0").over(earlier), "s0": F.sum("s0").over(earlier)}).where("n0 <> 0 or s0 <> 0")
    found = inside.join(carried, [*node, "bucket"], "left").groupBy(*LEVEL, "seq").agg(F.sum(F.col("n") + F.coalesce("n0", F.lit(0))).alias("before"), F.sum(F.col("s") + F.coalesce("s0", F.lit(0))).alias("ahead"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return live.join(found, [*LEVEL, "seq"], "left").select("seq", "order_id", *LEVEL, "size", (zero("before") + 1).alias("position"), zero("ahead").alias("size_ahead"))


def erase(orders: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return orders.join(keys, on, "left_anti")


def insert_absent(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with the rows of ``new`` whose key it lacks; of several with one key the first by ``order`` (which it drops)."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("first")).select(key, "first.*")
    return table.unionByName(first.select(table.columns).join(table, key, "left_anti"))


def enrich(rows: DataFrame, securities: DataFrame) -> DataFrame:
    """Adds symbol and scale by symbol_idx: those of the definition with the highest seq, null where there is none.

    Definitions are sent again and again; one is left of each of at most 65,536 ids (16 bits), so they are broadcast.
    """
    latest = securities.groupBy("symbol_idx").agg(F.max_by(F.struct("symbol", "scale"), "seq").alias("s")).select("symbol_idx", "s.symbol", "s.scale")
    return rows.join(F.broadcast(latest), "symbol_idx", "left")
