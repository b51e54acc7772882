"""Whole-batch codecs and SQL table functions against decoders that read one message at a time."""

import random
import struct

import pyarrow as pa
import pytest

from orderflow.sources import udtf, wire

LAYOUTS = {"S": "<Qc8sHH", "A": "<QcQqIHc", "D": "<QcQ", "C": "<QcQI", "M": "<QcQIqB", "R": "<QcQQIq"}
FIELDS = {"S": ("symbol", "symbol_idx", "scale"), "A": ("order_id", "price", "size", "symbol_idx", "side"), "D": ("order_id",), "C": ("order_id", "size"), "M": ("order_id", "size", "price", "priority_reset"), "R": ("order_id", "new_order_id", "size", "price")}
NAMES = [x.split()[0] for x in wire.MESSAGE.split(", ")]


def plain_native(data):
    if data is None or len(data) < 8:
        return []
    first, _, _, count = struct.unpack_from("<IHBB", data)
    at, out = 8, []
    for i in range(count):
        kind = chr(data[at + 8]) if at + 8 < len(data) else ""
        if kind not in LAYOUTS or at + struct.calcsize(LAYOUTS[kind]) > len(data):
            break
        time, _, *values = struct.unpack_from(LAYOUTS[kind], data, at)
        row = dict(zip(FIELDS[kind], values), seq=first + i, feed_time=time, msg_type=kind)
        row = {k: v.rstrip(b" \0").decode("latin1") if isinstance(v, bytes) else v for k, v in row.items()}
        row = {k: None if k in ("order_id", "new_order_id", "feed_time") and v >= 2**63 else bool(v) if k == "priority_reset" else v for k, v in row.items()}
        out.append(tuple(row.get(n) for n in NAMES))
        at += struct.calcsize(LAYOUTS[kind])
    return out


def plain_blocks(count, data):
    at, out = 0, []
    for i in range(count or 0):
        if at + 3 > len(data or b""):
            break
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 1 or at + 2 + size > len(data):
            break
        out.append((i, chr(data[at + 2]).rstrip(" \0"), data[at + 2 : at + 2 + size]))
        at += 2 + size
    return out


def packets(rnd, n):
    out = [None, b"", b"1234567", struct.pack("<IHBB", 5, 8, 45, 0), struct.pack("<IHBB", 5, 8, 45, 9)]
    for _ in range(n):
        body, count = b"", rnd.randrange(30)
        for _ in range(count):
            kind = rnd.choice("SADCMR")
            values = [rnd.choice([b"ken\0\0\0\0\0", b"wall    ", b"\xe9 x     "]) if f == "symbol" else rnd.choice([b"B", b"S", b" "]) if f == "side" else rnd.randrange(2) if f == "priority_reset" else rnd.randrange(2**16) if f in ("symbol_idx", "scale") else rnd.randrange(2**32) if f == "size" else rnd.randrange(-(2**62), 2**62) if f == "price" else rnd.choice([rnd.randrange(2**40), 2**63 - 1, 2**63, 2**64 - 1]) for f in FIELDS[kind]]
            body += struct.pack(LAYOUTS[kind], rnd.choice([rnd.randrange(2**50), 2**63]), kind.encode(), *values)
        data = bytearray(struct.pack("<IHBB", rnd.choice([rnd.randrange(2**32), 2**32 - 1]), 8 + len(body), 45, min(255, count + rnd.choice([0, 0, 3]))) + body)
        if len(data) > 8 and rnd.random() < 0.3:
            data[rnd.randrange(8, len(data))] = rnd.randrange(256)
        out.append(bytes(data[: rnd.randrange(len(data) + 1)] if rnd.random() < 0.2 else data))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_native_packets(seed):
    given = packets(random.Random(seed), 200 if seed else 0)
    packet, columns = wire.native_messages(pa.array(given, pa.binary()))
    want = [(i, row) for i, data in enumerate(given) for row in plain_native(data)]
    assert list(zip(packet.tolist(), zip(*(columns[n].to_pylist() for n in NAMES)))) == want
    packet, columns = wire.native_messages(pa.array(given, pa.binary()).slice(3))  # a part of a column
    assert list(zip((packet + 3).tolist(), columns["seq"].to_pylist())) == [(i, r[0]) for i, r in want if i >= 3]


@pytest.mark.parametrize("seed", range(6))
def test_blocks(seed):
    rnd = random.Random(seed)
    given = [(3, None), (0, b"\0\1A"), (None, b"\0\1A"), (2, b"\0\1A"), (2, b"\0\1"), (1, b"\0\0A")]
    for _ in range(200 if seed else 0):
        data = b"".join(len(b).to_bytes(2, "big") + b for b in (rnd.randbytes(rnd.randrange(1, 50)) for _ in range(rnd.randrange(20))))
        given.append((rnd.randrange(25), data[: rnd.randrange(len(data) + 1)] if rnd.random() < 0.4 else data))
    gram, columns = wire.blocks_of(pa.array([c for c, _ in given], pa.int32()), pa.array([b for _, b in given], pa.binary()))
    assert list(zip(gram.tolist(), zip(*(c.to_pylist() for c in columns)))) == [(i, row) for i, g in enumerate(given) for row in plain_blocks(*g)]


def test_packing_limits_and_all_types(spark):
    rows = [(0, 0, 7, 5, "S", 3, None, None, None, None, None, None, "ken", 10), (0, 0, 8, 6, "A", 3, 11, None, "B", -4, 9, None, None, None), (0, 0, 9, 7, "R", None, 11, 12, None, 5, 6, None, None, None), (1, 5, 2**32 - 1, 8, "M", None, 12, None, None, 1, 2, True, None, None), (1, 6, 3, 9, "D", None, 12, None, None, None, None, None, None, None)]
    schema = "line_id int, packet_no long, seq long, feed_time long, msg_type string, symbol_idx int, order_id long, new_order_id long, side string, price long, size long, priority_reset boolean, symbol string, scale int"
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, wire.unpack_native(wire.pack_native(df)).select(df.columns).collect()), key=repr) == sorted(rows, key=repr)
    many = spark.range(256).selectExpr("0 line_id", "0L packet_no", "id seq", "id feed_time", "'D' msg_type", "id order_id")
    for bad in (many, df.withColumn("msg_type", df.msg_type.substr(9, 1))):
        with pytest.raises(Exception, match="packet"):
            wire.pack_native(bad).collect()


def test_table_functions(spark):
    """Lost payloads, null counts and empty tables in SQL."""
    udtf.register(spark)
    grams = spark.createDataFrame([("a", 1, 2, b"\0\1A\0\2Bx"), ("b", 2, None, b"\0\1A"), ("c", 3, 1, None)], "session string, seqno long, msg_count int, blocks binary")
    want = [(1, 0, "A", bytearray(b"A")), (1, 1, "B", bytearray(b"Bx"))]
    every = spark.sql("SELECT seqno, idx, type, body FROM itch_messages(TABLE(SELECT * FROM {g}))", g=grams)
    lateral = spark.sql("SELECT seqno, m.* FROM {g}, LATERAL block_walk(msg_count, blocks) m", g=grams)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, lateral.collect())) == want
    assert spark.sql("SELECT * FROM itch_messages(TABLE(SELECT * FROM {g} WHERE seqno > 9))", g=grams).collect() == []
    packet = spark.createDataFrame([(0, 1, None), (0, 2, struct.pack("<IHBBQcQ", 5, 25, 45, 1, 9, b"D", 77))], "line_id int, packet_no long, payload binary")
    assert [tuple(r) for r in spark.sql("SELECT packet_no, m.seq, m.order_id FROM {p}, LATERAL native_walk(payload) m", p=packet).collect()] == [(2, 5, 77)]
