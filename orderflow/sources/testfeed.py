"""Order flow from the driver's tables, and the small hand-made feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas

#: What an event stands for.
TYPES = {"signup": "A", "click": "M", "view": "C", "purchase": "E", "error": "D"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_msgs(events: DataFrame) -> DataFrame:
    """``order_msgs`` from events: a signup adds an order, later events of the user act on the latest one."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), F.col("event_type"))
    mine = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    order = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(mine)
    msgs = events.select("event_id", "user_id", "ts", "value", "props", kind.alias("msg_type"), order.alias("order_id"))
    return msgs.select(
        F.lit(0).alias("line_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("feed_time"), "msg_type", F.col("user_id").cast("int").alias("symbol_idx"), "order_id",
        F.lit(None).cast("long").alias("new_order_id"), F.when(F.col("order_id") % 2 == 0, "B").when(F.col("order_id") % 2 == 1, "S").alias("side"),
        F.when(F.col("msg_type").isin("A", "M"), F.floor("value").cast("long")).alias("price"), F.when(F.col("msg_type") != "D", F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
        F.lit(False).alias("priority_reset"), F.when(F.col("msg_type") == "E", F.col("event_id")).alias("match_num"),
    )


def line_orders(lineitem: DataFrame) -> DataFrame:
    """Resting orders from lineitem, with all attempts to insert an id: insert_no orders them."""
    rest = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = lineitem.select(
        F.col("l_suppkey").cast("int").alias("symbol_idx"), F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("side"), order.alias("order_id"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("price"), F.floor("l_extendedprice").cast("long").alias("ticks"), F.col("l_quantity").cast("long").alias("size"), *rest,
    )
    return rows.withColumn("insert_no", F.row_number().over(W.partitionBy("order_id").orderBy(*rest))).select("symbol_idx", "side", "order_id", "price", "ticks", "size", "insert_no")


def resting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_idx, side, order_id, price, ticks, size, priority_seq): the first insert of each id."""
    return line_orders(table(spark, sf_dir, "lineitem")).where("insert_no = 1").drop("insert_no").withColumn("priority_seq", F.col("order_id"))


def securities(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").cast("int").alias("symbol_idx"), F.col("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 2 == 0, 10).otherwise(100).alias("scale"), F.col("s_suppkey").alias("seq"), F.lit(0).cast("long").alias("feed_time"))


def replace_edges(orders: DataFrame) -> DataFrame:
    """(new_id, old_id): each order of a customer replaces the one before."""
    mine = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("new_id"), F.lag("o_orderkey").over(mine).alias("old_id")).where("old_id is not null")


def aggressors(orders: DataFrame, symbols: int) -> DataFrame:
    """(symbol_idx, side, seq, quantity): orders that sweep the given side of a symbol's book, in the order of seq."""
    return orders.select((F.col("o_custkey") % symbols).cast("int").alias("symbol_idx"), F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("S").alias("side"), F.col("o_orderkey").alias("seq"), (F.floor(F.col("o_totalprice") / 10000) + 1).cast("long").alias("quantity"))


def golden_feed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Messages and security definitions of a feed of 18 messages of all native types."""
    add = [(19, 171234, 1717, 68, 100, 1968, "B"), (20, 171235, 1718, 67, 100, 1968, "B"), (21, 171236, 1719, 70, 100, 1968, "S"), (22, 171237, 1720, 69, 100, 1968, "S"), (23, 171238, 1721, 69, 100, 1968, "S")]
    add += [(24, 171238, 1722, 56, 100, 1969, "S"), (25, 171239, 1723, 55, 100, 1969, "S"), (26, 171240, 1724, 55, 100, 1969, "B")]
    rows = [(0, seq, t, "A", idx, oid, None, side, prc, sz, None, None) for seq, t, oid, prc, sz, idx, side in add]
    rows += [(0, 27, 171241, "C", None, 1719, None, None, None, 30, None, None), (0, 28, 171242, "C", None, 1724, None, None, None, 33, None, None)]
    rows += [(0, 29, 171243, "D", None, 1719, None, None, None, None, None, None), (0, 30, 171244, "D", None, 1724, None, None, None, None, None, None)]
    rows += [(0, 31, 171245, "M", None, 1723, None, None, 56, 85, True, None), (0, 32, 171246, "M", None, 1723, None, None, 57, 76, True, None)]
    rows += [(0, 33, 171247, "R", None, 1723, 1725, None, 56, 75, None, None), (0, 34, 171248, "D", None, 1725, None, None, None, None, None, None)]
    defs = [(1968, "ken", 10, 17, 171233), (1969, "wall", 100, 18, 171232)]
    return spark.createDataFrame(rows, schemas.ORDER_MSGS), spark.createDataFrame(defs, schemas.SECURITIES)
