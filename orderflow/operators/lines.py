"""Feed lines: numbering, gaps, merging, arbitration of redundant copies, traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sequence numbers in one bucket of the gap check.
BUCKET = 100_000


def number_packets(packets: DataFrame, start: int, bucket: int = BUCKET) -> DataFrame:
    """Adds first_seq to (line_id, packet_no, msg_cnt): the start plus all messages of earlier packets of the line.

    A line is cut into buckets of packet numbers: a packet counts within its bucket, and bucket totals add up in a window
    with one row for each bucket.
    """
    rows = packets.withColumn("_bucket", F.floor(F.col("packet_no") / bucket))
    totals = rows.groupBy(F.col("line_id").alias("_line"), F.col("_bucket").alias("_b")).agg(F.sum("msg_cnt").alias("_n"))
    earlier = W.partitionBy("_line").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_line", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_upto"))
    inside = W.partitionBy("line_id", "_bucket").orderBy("packet_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("msg_cnt").over(inside), F.lit(0)))
    out = rows.join(totals, (F.col("line_id") == F.col("_line")) & (F.col("_bucket") == F.col("_b")))
    return out.select(*packets.columns, (F.lit(start) + F.col("_upto") + F.col("_inside")).alias("first_seq"))


def gaps(packets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """line_id, first_seq, expected, kind (gap, overlap) where a packet does not follow the one before it.

    A line is cut into buckets of sequence numbers; only the ends of its buckets meet in one window.
    """
    rows = packets.select("line_id", "first_seq", "msg_cnt", F.floor(F.col("first_seq") / bucket).alias("bucket"))
    ends = rows.groupBy("line_id", "bucket").agg(F.max_by(F.col("first_seq") + F.col("msg_cnt"), F.struct("first_seq", "msg_cnt")).alias("end"))
    ends = ends.select("line_id", "bucket", F.lag("end").over(W.partitionBy("line_id").orderBy("bucket")).alias("earlier"))
    inside = F.lag(F.col("first_seq") + F.col("msg_cnt")).over(W.partitionBy("line_id", "bucket").orderBy("first_seq", "msg_cnt"))
    out = rows.withColumn("inside", inside).join(ends, ["line_id", "bucket"]).withColumn("expected", F.coalesce("inside", "earlier"))
    return out.where("expected <> first_seq").select("line_id", "first_seq", "expected", F.when(F.col("first_seq") > F.col("expected"), "gap").otherwise("overlap").alias("kind"))


def merge(*lines: DataFrame) -> DataFrame:
    """All messages of several lines; within a line they are ordered by seq where they are used."""
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def arbitrate(packets: DataFrame) -> DataFrame:
    """The copy of each (line_id, first_seq) that arrived first, ties to the lower phys_line.

    The winner is found on the keys alone, with partial minima before the shuffle; payloads are joined to winners.
    """
    winner = packets.groupBy("line_id", "first_seq").agg(F.min(F.struct("arrival_ns", "phys_line")).alias("w")).select("line_id", "first_seq", "w.*")
    return packets.join(winner, ["line_id", "first_seq", "arrival_ns", "phys_line"], "left_semi")


def traffic(packets: DataFrame) -> DataFrame:
    return packets.groupBy("line_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("msg_cnt").alias("messages"), F.sum("len").alias("bytes"))
