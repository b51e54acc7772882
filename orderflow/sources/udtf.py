"""Wire decoding for SQL: Arrow table functions over whole batches, and plain ones for one row at a time with LATERAL.

    SELECT * FROM itch_messages(TABLE(SELECT session, seqno, msg_count, blocks FROM datagrams))
    SELECT * FROM native_messages(TABLE(SELECT line_id, packet_no, payload FROM packets))
    SELECT d.seqno, m.idx, m.type FROM datagrams d, LATERAL block_walk(d.msg_count, d.blocks) m
    SELECT p.line_id, m.seq FROM packets p, LATERAL native_walk(p.payload) m

The first two decode a batch as a whole and need no partitioning, so tasks keep their rows. Arrow functions cannot stand
behind LATERAL, so the last two take rows; they are handy where other columns of the row are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import wire

_BLOCK = "idx int, type string, body binary"


@F.arrow_udtf(returnType=f"session string, seqno long, {_BLOCK}")
class ItchMessages:
    """All messages of a table (session, seqno, msg_count, blocks)."""

    def eval(self, grams: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gram, columns = wire.blocks_of(grams.column("msg_count"), grams.column("blocks"))
        take = pa.array(gram)
        yield pa.RecordBatch.from_arrays([grams.column("session").take(take), grams.column("seqno").take(take), *columns], ["session", "seqno", "idx", "type", "body"])


@F.arrow_udtf(returnType=wire.DECODED)
class NativeMessages:
    """All messages of a table (line_id, packet_no, payload)."""

    def eval(self, packets: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packet, columns = wire.native_messages(packets.column("payload"))
        own = [packets.column(c).take(pa.array(packet)) for c in ("line_id", "packet_no")]
        yield pa.RecordBatch.from_arrays([*own, *columns.values()], ["line_id", "packet_no", *columns])


@F.udtf(returnType=_BLOCK)
class BlockWalk:
    """The messages of one datagram: an empty or overrunning block ends it."""

    def eval(self, msg_count: int, blocks: bytes) -> Iterator[tuple]:
        yield from zip(*(c.to_pylist() for c in wire.blocks_of(pa.array([msg_count], pa.int32()), pa.array([blocks], pa.binary()))[1]))


@F.udtf(returnType=wire.MESSAGE)
class NativeWalk:
    """The messages of one native packet; a cut-off or unknown one ends it."""

    def eval(self, payload: bytes) -> Iterator[tuple]:
        yield from zip(*(c.to_pylist() for c in wire.native_messages(pa.array([payload], pa.binary()))[1].values()))


def register(spark: SparkSession) -> None:
    """Makes the four functions known to SQL of this session."""
    for name, function in (("itch_messages", ItchMessages), ("native_messages", NativeMessages), ("block_walk", BlockWalk), ("native_walk", NativeWalk)):
        spark.udtf.register(name, function)
