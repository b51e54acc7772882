"""Latency of sections and executed volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of the clock that times sections, where it counts ticks.
TICKS_PER_SECOND = 3.7e9


#: Units of time in one bucket of a section.
BUCKET = 3_600_000_000_000


def latency(timings: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(section, total_ns, calls, mean_ns) of (section, event start or stop, t_ns, n): n breaks ties of time.

    A start counts as a call; one that the next event of its section does not stop adds no time. A section is cut into
    buckets of time; the last event of a bucket looks at the first one of the next bucket that has any.
    """
    rows = timings.select("section", "event", "t_ns", "n", F.floor(F.col("t_ns") / bucket).alias("bucket"))
    one = F.struct("t_ns", "n", "event")
    firsts = rows.groupBy("section", "bucket").agg(F.min(one).alias("first"))
    firsts = firsts.select(F.col("section").alias("_section"), F.col("bucket").alias("_bucket"), F.lead("first").over(W.partitionBy("section").orderBy("bucket")).alias("later"))
    after = F.lead(one).over(W.partitionBy("section", "bucket").orderBy("t_ns", "n"))
    rows = rows.withColumn("inside", after).join(firsts, F.col("section").eqNullSafe(F.col("_section")) & (F.col("bucket") == F.col("_bucket")))
    rows = rows.withColumn("next", F.coalesce("inside", "later"))
    took = F.when((F.col("event") == "start") & (F.col("next.event") == "stop"), F.col("next.t_ns") - F.col("t_ns"))
    out = rows.groupBy("section").agg(F.coalesce(F.sum(took), F.lit(0)).alias("total_ns"), F.count_if(F.col("event") == "start").alias("calls"))
    return out.where("calls > 0").withColumn("mean_ns", F.col("total_ns") / F.col("calls"))


def seconds(ticks: Column, rate: float = TICKS_PER_SECOND) -> Column:
    """Seconds of a processor's ticks at a fixed rate."""
    return ticks / F.lit(rate)


def latency_ticks(timings: DataFrame, rate: float = TICKS_PER_SECOND, bucket: int = BUCKET) -> DataFrame:
    """(section, total_s, calls, mean_s) of timings whose clock counts ticks."""
    out = latency(timings, bucket)
    return out.select("section", seconds(F.col("total_ns"), rate).alias("total_s"), "calls", (seconds(F.col("total_ns"), rate) / F.col("calls")).alias("mean_s"))


def executed(msgs: DataFrame, *keys: str) -> DataFrame:
    """Shares and executions by symbol, or by symbol and order."""
    return msgs.where("msg_type = 'E'").groupBy(*keys).agg(F.sum("size").alias("shares"), F.count("match_num").alias("executions"))
