"""Tables that are kept: an index of book snapshots for any seq, and a keyed store with insert-if-absent and erase."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import cut
from ..schemas import LEVEL
from . import levels


@dataclass(frozen=True)
class SnapshotIndex:
    """Books as of any seq, in folders by bucket of ``width`` numbers and by run of buckets.

    A state of a level lasts from one change to the next. Where it covers a part of a bucket it stands in that bucket's folder of
    ``changes``; the whole buckets in between are split into dyadic runs (2^k buckets that begin at a multiple of it), two for each k at most,
    and it stands once in each run's folder of ``snapshots``. A book as of some seq is its bucket's states that hold then, and those of
    the log2(buckets) runs that its bucket lies in. Nothing is added up; other folders are not read.
    """

    spark: SparkSession
    folder: str
    width: int

    def _table(self, name: str) -> DataFrame:
        own = "from_seq long, to_seq long, " if name == "changes" else ""
        return self.spark.read.schema(f"{own}symbol_idx int, side string, price long, agg_size long, num_orders long, bucket long").parquet(f"{self.folder}/{name}")

    def at(self, seq: int) -> DataFrame:
        """symbol_idx, side, price, agg_size, num_orders: levels with an order as of message ``seq``."""
        bucket = seq // self.width
        runs = [_run(k, bucket >> k) for k in range(bucket.bit_length())]
        lasting = self._table("snapshots").where(F.col("bucket").isNotNull() & F.col("bucket").isin(runs))
        own = self._table("changes").where((F.col("bucket") == bucket) & (F.col("from_seq") <= seq) & (F.col("to_seq") > seq))
        return lasting.select(*LEVEL, "agg_size", "num_orders").unionByName(own.select(*LEVEL, "agg_size", "num_orders"))

    def at_many(self, wanted: DataFrame) -> DataFrame:
        """The same for each ``at_seq`` of ``wanted``, with at_seq. Only what is asked for takes part; the books are put out as they are joined, without a shuffle."""
        asked = wanted.select("at_seq", F.expr(f"at_seq div {self.width}").alias("bucket")).distinct()
        runs = asked.select("at_seq", F.explode(F.expr(f"transform(filter(sequence(0, 62), k -> shiftright(bucket, k) > 0), k -> {_RUN.format(k='k', i='shiftright(bucket, k)')})")).alias("bucket"))
        runs = runs.distinct()  # its size is known before it is joined
        lasting = self._table("snapshots").join(runs, "bucket").select("at_seq", *LEVEL, "agg_size", "num_orders")
        own = self._table("changes").join(asked, "bucket").where("from_seq <= at_seq and at_seq < to_seq").select("at_seq", *LEVEL, "agg_size", "num_orders")
        return lasting.unionByName(own)


#: Number of the run of 2^k buckets that begins at i * 2^k: each run has its own, however many there are.
_RUN = "shiftleft(2 * {i} + 1, {k}) - 1"


def _run(k: int, i: int) -> int:
    return ((2 * i + 1) << k) - 1


def index_snapshots(deltas: DataFrame, folder: str, width: int) -> SnapshotIndex:
    """Writes the index of ``deltas`` to ``folder``; seq starts at 0 or above.

    A state is written once for each of its runs, so the index grows with the changes and the logarithm of the buckets, not with buckets times
    levels. States are range-partitioned by folder, so that a folder is few files. Past the last change's bucket there is no book.
    """
    spark = deltas.sparkSession
    index = SnapshotIndex(spark, folder, width)
    history = cut(levels.history(deltas).select("seq", *LEVEL, "agg_size", "num_orders", "next_seq"))
    end = ((history.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]) // width + 1) * width
    states = history.where("num_orders > 0").withColumn("to_seq", F.coalesce("next_seq", F.lit(end))).where("to_seq > seq")
    states = states.withColumns({"a": F.expr(f"seq div {width}"), "b": F.expr(f"to_seq div {width}")})
    # the first bucket's part, and the last one's where there is another that it does not fill
    first = f"struct(seq AS from_seq, least(to_seq, (a + 1) * {width}) AS to_seq, a AS bucket)"
    last = f"struct(b * {width} AS from_seq, to_seq, b AS bucket)"
    own = states.select(*LEVEL, "agg_size", "num_orders", F.explode(F.expr(f"filter(array({first}, IF(b > a, {last}, NULL)), x -> x.from_seq < x.to_seq)")).alias("x"))
    own.select("x.from_seq", "x.to_seq", *LEVEL, "agg_size", "num_orders", "x.bucket").repartitionByRange("bucket").write.partitionBy("bucket").parquet(f"{folder}/changes")
    # whole buckets from a + 1 to b: at 2^k the whole runs are those from ceil((a + 1) / 2^k) to floor(b / 2^k), and only an odd end is no part of a larger one
    top = max(1, (end // width).bit_length())
    ends = f"transform(sequence(0, {top}), k -> struct(k, shiftright(a + shiftleft(1L, k), k) AS lo, shiftright(b, k) AS hi))"
    runs = "flatten(transform(filter(ends, e -> e.lo < e.hi), e -> filter(array(struct(e.k, e.lo AS i, e.lo % 2 = 1 AS odd), struct(e.k, e.hi - 1 AS i, e.hi % 2 = 1 AS odd)), n -> n.odd)))"
    lasting = states.where("b > a + 1").withColumn("ends", F.expr(ends)).select(*LEVEL, "agg_size", "num_orders", F.explode(F.expr(runs)).alias("n"))
    lasting.select(*LEVEL, "agg_size", "num_orders", F.expr(_RUN.format(k="n.k", i="n.i")).alias("bucket")).repartitionByRange("bucket").write.partitionBy("bucket").parquet(f"{folder}/snapshots")
    return index


@dataclass(frozen=True)
class KeyedTable:
    """A catalog table with one row for each key, in ``parts`` folders by hash of the key and in ``buckets`` files of each.

    Changes rewrite only the folders of the keys that they touch. The table is bucketed by the key, so a join on it moves the other
    side's rows to its buckets and none of its own. Keys are not null.
    """

    spark: SparkSession
    name: str
    key: str
    parts: int = 16
    buckets: int = 8

    def _part(self) -> Column:
        return F.pmod(F.hash(F.lit(17), self.key), F.lit(self.parts)).alias("part")

    def create(self, rows: DataFrame) -> None:
        """The table from rows whose keys are unique."""
        rows = rows.select("*", self._part()).repartition(self.buckets, self.key)  # a task for each bucket, so a folder has one file of each
        rows.write.partitionBy("part").bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def insert_absent(self, new: DataFrame, order: str) -> DataFrame:
        """Adds the rows of ``new`` whose key the table lacks, of several with one key the first by ``order`` (which is no column of the table).

        Returns key and inserted for each key of ``new``. A second run with the same rows changes nothing.
        """
        columns = self.read().columns
        first = new.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(order, *(c for c in columns if c != self.key))).alias("first")).select(self.key, *(F.col(f"first.{c}").alias(c) for c in columns if c != self.key))
        known = self.read().select(self.key, F.lit(True).alias("_known"))
        told = cut(first.join(known, self.key, "left"))
        fresh = told.where("_known is null").select(*columns, self._part())
        self._rewrite(fresh.select("part").distinct(), lambda kept: kept.unionByName(fresh))
        return told.select(self.key, F.col("_known").isNull().alias("inserted"))

    def erase(self, keys: DataFrame) -> DataFrame:
        """Drops the rows of the given keys; returns key and erased (false where there was none)."""
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        told = cut(keys.join(self.read().select(self.key, F.lit(True).alias("_known")), self.key, "left").select(self.key, F.col("_known").isNotNull().alias("erased")))
        gone = told.where("erased").select(self.key, self._part())
        self._rewrite(gone.select("part").distinct(), lambda kept: kept.join(gone.select(self.key), self.key, "left_anti"))
        return told

    def _rewrite(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the touched folders, at most ``parts``, by what ``change`` makes of their rows."""
        parts = [r["part"] for r in touched.collect()]
        if not parts:
            return
        columns = self.spark.table(self.name).columns
        now = cut(change(self.spark.table(self.name).where(F.col("part").isin(parts))).select(columns))  # cannot write what it still reads
        for part in set(parts) - {r["part"] for r in now.select("part").distinct().collect()}:  # nothing is left of them
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = {part})")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")  # an option of the write does not reach inserts into a table
        try:
            now.repartition(self.buckets, self.key).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
