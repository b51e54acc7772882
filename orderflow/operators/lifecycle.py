"""Order lifecycle: identity over replaces, state after each message, changes of price levels, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cut import cut


def chain_roots(edges: DataFrame) -> DataFrame:
    """(id, root) for every id that replaced another, from (new_id, old_id): pointer jumping, log2(depth) rounds.

    Each id replaces one other at most. Ids that replace each other in a circle have no root: that is an error.
    """
    up = cut(edges.select(F.col("new_id").alias("id"), F.col("old_id").alias("root")))
    for _ in range(up.count().bit_length() + 1):
        over = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = cut(up.join(over, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = step.select("id", "root")
        if step.where("moved").isEmpty():
            return up
    raise ValueError("ids replace each other in a circle")


def identities(msgs: DataFrame) -> DataFrame:
    """Every message that names an order, with chain (the id that its order was added with), chosen (an R that passes the
    order on to a new id) and first_add (an A that brings its id up). Needs the A and R rows only, and joins on ids.
    """
    ids = W.partitionBy("line_id", "id").orderBy("seq")
    uses = msgs.where("msg_type in ('A', 'R')").select("line_id", "seq", F.when(F.col("msg_type") == "A", F.col("order_id")).otherwise(F.col("new_order_id")).alias("id")).where("id is not null")
    born = uses.groupBy("line_id", "id").agg(F.min("seq").alias("birth"))
    replaces = msgs.where("msg_type = 'R' and order_id is not null").select("line_id", "seq", F.col("order_id").alias("id"), "new_order_id")
    fresh = born.select("line_id", F.col("id").alias("new_order_id"), F.col("birth").alias("seq"))
    chosen = replaces.join(fresh, ["line_id", "new_order_id", "seq"]).join(born, ["line_id", "id"]).where("seq > birth")  # one to an id that exists passes nothing on
    chosen = cut(chosen.withColumn("n", F.row_number().over(ids)).where("n = 1").select("line_id", "seq", "id", "new_order_id"))
    msgs = msgs.where("order_id is not null")
    named = msgs.withColumn("chain", F.col("order_id"))
    if not chosen.isEmpty():
        key = lambda c: F.struct("line_id", c)
        roots = chain_roots(chosen.select(key(F.col("new_order_id").alias("id")).alias("new_id"), key(F.col("id")).alias("old_id")))
        roots = roots.select(F.col("id.line_id").alias("line_id"), F.col("id.id").alias("order_id"), F.col("root.id").alias("root"))
        named = msgs.join(roots, ["line_id", "order_id"], "left").withColumn("chain", F.coalesce("root", "order_id")).drop("root")
    named = named.join(chosen.select("line_id", "seq", F.lit(True).alias("chosen")), ["line_id", "seq"], "left")
    births = born.select("line_id", F.col("id").alias("order_id"), "birth")
    return named.join(births, ["line_id", "order_id"], "left").withColumn("first_add", (F.col("msg_type") == "A") & (F.col("seq") == F.col("birth"))).drop("birth")


def order_states(msgs: DataFrame) -> DataFrame:
    """Every message with chain, reason (null, or why it is rejected), symbol_idx, side, price, rem and what was before.

    Accepted messages have the order's state after the message (rem, price, priority_seq) and before it (was_rem,
    was_price). Reasons: duplicate (an id that exists), unknown (no such order), stale (an id that has been replaced),
    dead (the order has left). Once ids are resolved, all is windows over one partitioning by chain. Messages without an
    order id are unknown, and never meet there.
    """
    named = identities(msgs)
    chain = W.partitionBy("line_id", "chain").orderBy("seq")
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    upto = chain.rowsBetween(W.unboundedPreceding, 0)
    known = F.coalesce(F.max("first_add").over(earlier), F.lit(False))
    current = F.last(F.when(F.col("first_add"), F.col("order_id")).when(F.col("chosen"), F.col("new_order_id")), ignorenulls=True).over(earlier)
    is_stale = ((F.col("msg_type") == "R") & F.col("chosen").isNull()) | ~F.col("order_id").eqNullSafe(current)
    reason = F.when(F.col("msg_type") == "A", F.when(~F.col("first_add"), "duplicate")).when(~known | F.col("order_id").isNull(), "unknown").when(is_stale, "stale")
    rows = named.withColumn("reason", reason)

    # rejected rows stay in the partitioning, with values that change nothing
    ok = F.col("reason").isNull()
    sets = ok & F.col("msg_type").isin("A", "M", "R")
    keep = lambda c: F.last(F.when(sets, F.col(c)), ignorenulls=True).over(upto)
    rows = rows.withColumns({"seg": F.sum(F.when(sets, 1).otherwise(0)).over(upto), "now_price": keep("price"), "now_symbol": keep("symbol_idx"), "now_side": keep("side")})
    segment = W.partitionBy("line_id", "chain", "seg").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    moved = F.when(sets, F.col("size")).when(ok & F.col("msg_type").isin("C", "E"), -F.col("size")).otherwise(0)
    gone = F.max(F.when(ok & (F.col("msg_type") == "D"), 1).otherwise(0)).over(segment)
    rows = rows.withColumn("rem", F.when(gone == 1, 0).otherwise(F.greatest(F.lit(0), F.sum(moved).over(segment))))
    death = F.min(F.when(F.col("reason").isNull() & (F.col("rem") == 0), F.col("seq"))).over(W.partitionBy("line_id", "chain"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("seq") > death), "dead").otherwise(F.col("reason")))
    # of the row before; rows of other reasons repeat the state, and dead ones come last
    rows = rows.withColumns({"was_rem": F.coalesce(F.lag("rem").over(chain), F.lit(0)), "was_price": F.lag("now_price").over(chain)})
    first_seen = F.col("msg_type").isin("A", "R") | F.coalesce("priority_reset", F.lit(False)) | (F.col("now_price") != F.col("was_price"))
    rows = rows.withColumn("priority_seq", F.last(F.when(sets & first_seen, F.col("seq")), ignorenulls=True).over(upto))
    rows = rows.select("line_id", "seq", "feed_time", "msg_type", "order_id", "new_order_id", "chain", F.col("now_symbol").alias("symbol_idx"), F.col("now_side").alias("side"), F.col("now_price").alias("price"), "size", "rem", "was_rem", "was_price", "priority_seq", "reason")
    nobody = {"rem": F.lit(0), "was_rem": F.lit(0), "reason": F.lit("unknown"), "chain": F.lit(None), "symbol_idx": F.lit(None), "side": F.lit(None), "price": F.lit(None), "was_price": F.lit(None), "priority_seq": F.lit(None)}
    lost = msgs.where("order_id is null").withColumns({c: v.cast(rows.schema[c].dataType) for c, v in nobody.items()})
    return rows.unionByName(lost.select(rows.columns))


def rejects(states: DataFrame) -> DataFrame:
    return states.where("reason is not null").select("seq", "order_id", "msg_type", "reason")


def deltas(states: DataFrame) -> DataFrame:
    """Net change of each level by each message: the order leaves its old level and joins its new one."""
    ok = states.where("reason is null")
    both = F.array(F.struct(F.col("was_price").alias("price"), (-F.col("was_rem")).alias("d_size"), F.when(F.col("was_rem") > 0, -1).otherwise(0).alias("d_orders")), F.struct("price", F.col("rem").alias("d_size"), F.when(F.col("rem") > 0, 1).otherwise(0).alias("d_orders")))
    rows = ok.select("seq", "feed_time", "symbol_idx", "side", F.explode(both).alias("d")).select("seq", "feed_time", "symbol_idx", "side", "d.*").where("price is not null")
    net = rows.groupBy("seq", "symbol_idx", "side", "price").agg(F.max("feed_time").alias("feed_time"), F.sum("d_size").alias("d_size"), F.sum("d_orders").cast("long").alias("d_orders"))
    return net.where("d_size <> 0 or d_orders <> 0").select("seq", "feed_time", "symbol_idx", "side", "price", "d_size", "d_orders")


def live_orders(states: DataFrame) -> DataFrame:
    """Orders that still rest: symbol_idx, side, order_id, price, size, priority_seq, last_seq."""
    last = W.partitionBy("line_id", "chain").orderBy(F.desc("seq"))
    now = F.when(F.col("msg_type") == "R", F.col("new_order_id")).otherwise(F.col("order_id"))
    rows = states.where("reason is null").withColumn("n", F.row_number().over(last)).where("n = 1 and rem > 0")
    return rows.select("symbol_idx", "side", now.alias("order_id"), "price", F.col("rem").alias("size"), "priority_seq", F.col("seq").alias("last_seq"))
