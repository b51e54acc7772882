"""Hand-made feeds, wire vectors, random flows against a plain fold, streams against batch."""

import random

import pytest
from pyspark.sql import functions as F

from orderflow import schemas
from orderflow.functions import scalars
from orderflow.functions.cut import shared_folder
from orderflow.operators import bbo, levels, lifecycle, lines, matching, stats
from orderflow.sources import testfeed, wire
from orderflow.streaming import book as streams


def test_golden_feed(spark):
    msgs, defs = testfeed.golden_feed(spark)
    states = lifecycle.order_states(msgs)
    deltas = lifecycle.deltas(states)
    assert lifecycle.rejects(states).count() == 0
    book = {(r.symbol_idx, r.side, r.price): (r.agg_size, r.num_orders, r.last_seq) for r in levels.snapshot(deltas).collect()}
    assert book == {(1968, "B", 68): (100, 1, 19), (1968, "B", 67): (100, 1, 20), (1968, "S", 69): (200, 2, 23), (1969, "S", 56): (100, 1, 34)}
    changes = {(r.seq, r.side, r.price, r.agg_size, r.num_orders) for r in levels.history(deltas).where("symbol_idx = 1969").collect()}
    assert changes == {
        (24, "S", 56, 100, 1), (25, "S", 55, 100, 1), (26, "B", 55, 100, 1), (28, "B", 55, 67, 1), (30, "B", 55, 0, 0), (31, "S", 55, 0, 0), (31, "S", 56, 185, 2),
        (32, "S", 56, 100, 1), (32, "S", 57, 76, 1), (33, "S", 57, 0, 0), (33, "S", 56, 175, 2), (34, "S", 56, 100, 1),
    }
    early = {(r.symbol_idx, r.side, r.price): (r.agg_size, r.num_orders) for r in levels.snapshot(deltas, 26).where("symbol_idx = 1968").collect()}
    assert early == {(1968, "B", 68): (100, 1), (1968, "B", 67): (100, 1), (1968, "S", 69): (200, 2), (1968, "S", 70): (100, 1)}
    shown = levels.snapshot(deltas).join(F.broadcast(defs.select("symbol_idx", "symbol", "scale")), "symbol_idx").withColumn("p", scalars.display_price(F.col("price"), F.col("scale")))
    assert {(r.symbol, float(r.p)) for r in shown.collect()} == {("ken", 6.8), ("ken", 6.7), ("ken", 6.9), ("wall", 0.56)}


def test_golden_packets(spark):
    msgs, defs = testfeed.golden_feed(spark)
    sizes = [2, 2, 3, 3, 2, 2, 2, 2]
    packet = [i + 1 for i, n in enumerate(sizes) for _ in range(n)]
    both = msgs.withColumns({"symbol": F.lit(None).cast("string"), "scale": F.lit(None).cast("int")})
    rows = [(17 + i, p) for i, p in enumerate(packet)]
    numbered = both.join(spark.createDataFrame(rows, "seq long, packet_no long"), "seq")
    packed = wire.pack_native(numbered)
    heads = {r.packet_no: (r.first_seq, r.len, r.ver, r.msg_cnt) for r in wire.packet_headers(packed).collect()}
    assert heads == {2: (19, 72, 45, 2), 3: (21, 104, 45, 3), 4: (24, 104, 45, 3), 5: (27, 50, 45, 2), 6: (29, 42, 45, 2), 7: (31, 68, 45, 2), 8: (33, 62, 45, 2)}
    back = {r.seq: (r.msg_type, r.order_id, r.new_order_id, r.price, r.size, r.side, r.priority_reset) for r in wire.unpack_native(packed).collect()}
    assert back == {r.seq: (r.msg_type, r.order_id, r.new_order_id, r.price, r.size, r.side, r.priority_reset) for r in msgs.collect()}


def resting(spark):
    rows = [(1, "B", oid, 45000, 250, i) for i, oid in enumerate((1001, 1004, 1005, 1006))] + [(1, "B", 1002, 44980, 500, 5), (1, "B", 1003, 44950, 900, 6), (1, "S", 2001, 45020, 400, 7)]
    return spark.createDataFrame(rows, "symbol_idx int, side string, order_id long, price long, size long, priority_seq long")


@pytest.mark.parametrize("quantity, filled, left", [(1000, 1000, {44980: 500, 44950: 900}), (1100, 1100, {44980: 400, 44950: 900}), (5000, 2400, {})])
def test_sweep(spark, quantity, filled, left):
    bids = resting(spark).where("side = 'B'")
    fills = matching.sweep(bids, quantity)
    assert fills.agg(F.sum("fill_size")).first()[0] == filled
    gone = {r.order_id: r.fill_size for r in fills.collect()}
    after = {}
    for r in bids.collect():
        if r.size > gone.get(r.order_id, 0):
            after[r.price] = after.get(r.price, 0) + r.size - gone.get(r.order_id, 0)
    assert after == left
    many = matching.sweep_many(bids, spark.createDataFrame([(1, "B", 1, quantity)], "symbol_idx int, side string, seq long, quantity long"), bucket=300)
    assert {(r.order_id, r.fill_size) for r in many.collect()} == set(gone.items())


def test_levels(spark):
    built = levels.build(resting(spark))
    assert [r.price for r in levels.level_at(built, 1).collect()] == [44980]
    assert levels.volume_vector(built).where("side = 'B'").first().volumes == [1000, 500, 900]
    assert {(r.price, r.next_price) for r in levels.next_level(built).where("side = 'B'").collect()} == {(45000, 44980), (44980, 44950), (44950, None)}
    assert levels.best_bid_offer(built).first().asDict() == {"symbol_idx": 1, "bid_price": 45000, "bid_size": 1000, "ask_price": 45020, "ask_size": 400}
    old, new = spark.createDataFrame([(1, 5)], "price long, v int"), spark.createDataFrame([(1, 9, 1), (2, 7, 3), (2, 8, 2), (2, 6, 4)], "price long, v int, n int")
    assert sorted(map(tuple, levels.insert_absent(old, new, "price", "n").collect())) == [(1, 5), (2, 8)]


def test_definitions_and_sides(spark):
    defs = spark.createDataFrame([(1, "new", 10, 7, 0), (1, "old", 1, 3, 0), (2, "b", 5, 1, 0)], schemas.SECURITIES)
    out = levels.enrich(spark.createDataFrame([(1,), (2,), (3,)], "symbol_idx int"), defs).collect()
    assert sorted(map(tuple, out)) == [(1, "new", 10), (2, "b", 5), (3, None, None)]
    sides = spark.createDataFrame([(x,) for x in ("B", "buy ", "SELL", "s", "x", None)], "s string")
    assert [tuple(r) for r in sides.select(scalars.side_code(F.col("s")), scalars.side_word(F.col("s"))).collect()] == [("B", "BUY")] * 2 + [("S", "SELL")] * 2 + [(None, None)] * 2


def test_ids_in_a_circle(spark):
    with pytest.raises(ValueError):
        lifecycle.chain_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "new_id long, old_id long"))


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.pack_level(F.lit(3), F.lit(171234)).alias("p"), scalars.pack_level(F.lit(65536 + 3), F.lit(2**48 + 5)).alias("masked"), scalars.page(F.lit(1500), 0).alias("page"), scalars.slot(F.lit(1500), 0).alias("slot"),
        *(scalars.in_bounds(F.lit(x), 0, m).alias(f"b{i}") for i, (x, m) in enumerate(((-1, 2047), (2048, 2047), (2047, 2000)))), scalars.big_endian(F.unhex(F.lit("FFFFFFFFFFFFFFFF")), 0, 8).alias("u64"),
    ).first()
    assert (row.p, row.masked, row.page, row.slot, row.b0, row.b1, row.b2, int(row.u64)) == (11221991427, (5 << 16) + 3, 1, 476, False, False, True, 2**64 - 1)


def frame(blocks, count=None, session=b"SESSION001", seq=1):
    body = b"".join(len(b).to_bytes(2, "big") + b for b in blocks)
    return b"\0" * 42 + session + seq.to_bytes(8, "big") + (len(blocks) if count is None else count).to_bytes(2, "big") + b"\0\0" + body


def test_wire_vectors(spark):
    def add(kind=b"A", ref=7, shares=4_000_000_000, more=b""):
        return kind + (9).to_bytes(2, "big") + b"\0\0" + (2**48 - 1).to_bytes(6, "big") + ref.to_bytes(8, "big") + b"B" + shares.to_bytes(4, "big") + b"AAPL    " + (1234567).to_bytes(4, "big") + more

    execute, delete = b"E" + bytes(10) + (7).to_bytes(8, "big") + (5).to_bytes(4, "big") + (2**64 - 1).to_bytes(8, "big"), b"D" + bytes(10) + (7).to_bytes(8, "big")
    cases = {
        "all": (frame([add(), execute, delete, add(b"F", more=b"MPID")]), "AEDF"),
        "short": (b"\0" * 42 + b"x" * 21, ""),
        "none": (frame([add()], count=0), ""),
        "prefix": (b"\0" * 42, ""),
        "missing": (frame([add(), delete], count=5), "AD"),
        "fewer": (frame([add(), delete], count=1), "A"),
        "empty block": (frame([add(), b"", delete], count=3), "A"),
        "overrun": (frame([add()], count=2) + (90).to_bytes(2, "big") + delete, "A"),
        "others": (frame([add(), b"S" * 12, b"R" * 39, b"X" * 23, b"U" * 35, add()]), "AA"),
        "cut A": (frame([delete, add()[:35], delete]), "DD"),
    }
    frames = spark.createDataFrame([(k, bytearray(f)) for k, (f, _) in cases.items()], "case string, frame binary")
    for case, (_, kinds) in cases.items():
        out = wire.long_enough(wire.messages(wire.datagrams(frames.where(F.col("case") == case)))).orderBy("idx").collect()
        assert "".join(r.type for r in out) == kinds, case
    msgs = wire.messages(wire.datagrams(frames.where("case = 'all'")))
    first = wire.decode_add(msgs).orderBy("seq").first()
    assert (first.locate, first.ts_ns, int(first.ref), first.side, first.shares, first.stock, float(first.price)) == (9, 2**48 - 1, 7, "B", 4_000_000_000, "AAPL", 123.4567)
    assert int(wire.decode_execute(msgs).first().match_num) == 2**64 - 1
    assert wire.decode_execute(msgs).select(F.col("match_num").try_cast("long")).first()[0] is None


def random_flow(seed, n=400):
    rnd, rows, ids, fresh = random.Random(seed), [], [], 1
    for seq in range(n):
        kind = rnd.choice("AAACDMRE")
        oid = rnd.choice(ids) if ids and rnd.random() < 0.95 else 10_000 + rnd.randrange(5)
        new = None
        if kind == "A":
            oid, fresh = (rnd.choice(ids), fresh) if ids and rnd.random() < 0.05 else (fresh, fresh + 1)
            ids.append(oid)
        if kind == "R":
            new, fresh = fresh, fresh + 1
            ids.append(new)
        size = rnd.choice([0, 5, 10, 20, 40]) if kind in "MR" else rnd.choice([5, 10, 20, 40])
        rows.append((0, seq, seq // 2, kind, 3 if kind == "A" else None, oid, new, rnd.choice("BS") if kind == "A" else None, rnd.randrange(95, 105) if kind in "AMR" else None, None if kind == "D" else size, rnd.random() < 0.3 if kind == "M" else None, None))
    return rows


def fold(rows):
    """Plain replay: live orders, rejected seqs."""
    live, seen, rejects = {}, set(), set()
    for _, seq, _, kind, _, oid, new, side, price, size, _, _ in rows:
        if kind == "A":
            if oid in seen:
                rejects.add(seq)
            else:
                seen.add(oid)
                live[oid] = [side, price, size]
            continue
        if oid not in live or (kind == "R" and new in seen):
            rejects.add(seq)
            if kind == "R":
                seen.add(new)
            continue
        o = live[oid]
        if kind in "CE":
            o[2] = max(0, o[2] - size)
        elif kind == "D":
            o[2] = 0
        else:
            o[1:] = [price, size]
        if kind == "R":
            seen.add(new)
            live[new] = live.pop(oid)
            oid = new
        if not live[oid][2]:
            del live[oid]
    return live, rejects


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_flow(spark, seed):
    rows = random_flow(seed)
    live, rejects = fold(rows)
    states = lifecycle.order_states(spark.createDataFrame(rows, schemas.ORDER_MSGS)).cache()
    assert {r.seq for r in lifecycle.rejects(states).collect()} == rejects
    assert {r.order_id: [r.side, r.price, r.size] for r in lifecycle.live_orders(states).collect()} == live
    deltas = lifecycle.deltas(states).cache()
    book = {(r.side, r.price): (r.agg_size, r.num_orders) for r in levels.snapshot(deltas).collect()}
    want = {}
    for side, price, size in live.values():
        s, n = want.get((side, price), (0, 0))
        want[side, price] = (s + size, n + 1)
    assert book == want
    history = levels.history(deltas)
    whole = sorted(map(tuple, bbo.timeline(history, 10**6).collect()))
    assert sorted(map(tuple, bbo.timeline(history, 37).collect())) == whole


def naive_sweeps(rows):
    """Fills by plain lists, one message after the other, with the rules of a feed: ids are used once."""
    resting, seen, fills = [], set(), []  # resting: [id, symbol, side, price, size, priority]
    for _, seq, _, kind, symbol, oid, new, side, price, size, reset, _ in rows:
        if kind == "X":
            mine = [o for o in resting if o[1] == symbol and o[2] == side]
            for o in sorted(mine, key=lambda o: (-o[3] if side == "B" else o[3], o[5])):
                fill = min(size, o[4])
                if fill:
                    size -= fill
                    o[4] -= fill
                    fills.append((seq, symbol, side, o[3], o[0], fill, o[4]))
            resting = [o for o in resting if o[4] > 0]
            continue
        if kind == "A":
            if oid not in seen:
                resting.append([oid, symbol, side, price, size, seq])
            seen.add(oid)
            continue
        taken = new in seen
        if kind == "R":
            seen.add(new)
        for o in [o for o in resting if o[0] == oid and not taken]:
            if kind in "CE":
                o[4] -= size
            elif kind == "D":
                o[4] = 0
            else:
                o[5] = seq if kind == "R" or reset or price != o[3] else o[5]
                o[3:5] = price, size
                o[0] = new if kind == "R" else oid
        resting = [o for o in resting if o[4] > 0]
    return fills


@pytest.mark.parametrize("seed", [5, 6])
def test_interleaved_sweep(spark, seed):
    """Native messages: only adds and aggressors tell a symbol; ids repeat, die, are replaced and are taken."""
    rnd, rows = random.Random(seed), []
    for r in random_flow(seed, 500):
        r = list(r)
        if r[3] == "A":
            r[4] = rnd.randrange(1, 3)
        if r[3] == "R" and rnd.random() < 0.1:
            r[6] = rnd.randrange(1, 30)  # an id that is there
        if rnd.random() < 0.15:
            r[3:10] = ["X", rnd.randrange(1, 3), None, None, rnd.choice("BS"), None, rnd.randrange(1, 60)]
        rows.append(tuple(r))
    got = matching.sweep_interleaved(spark.createDataFrame(rows, schemas.ORDER_MSGS)).collect()
    assert len(got) > 50 and sorted(map(tuple, got)) == sorted(naive_sweeps(rows))


def test_sweep_of_golden_feed(spark):
    """An order that was cut and deleted fills nobody."""
    msgs, _ = testfeed.golden_feed(spark)
    takers = spark.createDataFrame([(0, 100, 0, "X", 1968, None, None, "S", None, 500, None, None), (0, 101, 0, "X", 1969, None, None, "S", None, 120, None, None)], schemas.ORDER_MSGS)
    got = matching.sweep_interleaved(msgs.unionByName(takers)).collect()
    assert sorted((r.aggressor_seq, r.price, r.order_id, r.fill_size) for r in got) == [(100, 69, 1720, 100), (100, 69, 1721, 100), (101, 56, 1722, 100)]


def test_latency_and_gaps(spark):
    t = spark.createDataFrame([("x", "start", 0, 0), ("x", "stop", 100, 1), ("x", "start", 200, 2), ("x", "stop", 400, 3), ("x", "start", 500, 4)], "section string, event string, t_ns long, n long")
    assert tuple(stats.latency(t).first()) == ("x", 300, 3, 100.0) and tuple(stats.latency(t, 150).first()) == ("x", 300, 3, 100.0)
    assert tuple(stats.latency_ticks(t, 100.0).first()) == ("x", 3.0, 3, 1.0)
    packets = spark.createDataFrame([(i % 2, i, i % 5 + 1) for i in range(100)], "line_id int, packet_no long, msg_cnt long")
    firsts = {(r.line_id, r.packet_no): r.first_seq for r in lines.number_packets(packets, 10, 7).collect()}
    assert all(firsts[i % 2, i] == 10 + sum(j % 5 + 1 for j in range(i % 2, i, 2)) for i in range(100))
    p = spark.createDataFrame([(1, 1, 5), (1, 6, 5), (1, 12, 3), (1, 14, 1), (1, 2001, 1)], "line_id int, first_seq long, msg_cnt long")
    assert sorted((r.first_seq, r.expected, r.kind) for r in lines.gaps(p, 1000).collect()) == [(12, 11, "gap"), (14, 15, "overlap"), (2001, 15, "gap")]


def streamed(spark, parts, extra=""):
    folder, out = shared_folder(spark, "split"), None
    streams.rocks(spark)
    for part in parts:
        frame = spark.createDataFrame(part, schemas.ORDER_MSGS + extra)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = streams.run_once(streams.book(spark.readStream.schema(frame.schema).parquet(f"{folder}/in")), folder)
    return out


def test_stream_book_splits(spark):
    """Any split of a flow with all kinds of messages and rejects into micro-batches gives the batch result."""
    rows = random_flow(9, 150)
    assert {r[3] for r in rows} == set("ACDMRE")
    states = lifecycle.order_states(spark.createDataFrame(rows, schemas.ORDER_MSGS)).cache()
    want = {tuple(r) for r in lifecycle.deltas(states).select("seq", "symbol_idx", "side", "price", "d_size", "d_orders").collect()}
    out = streamed(spark, (rows[:50], rows[50:60], rows[60:], rows[:1]))
    assert {tuple(r) for r in out.where("reason is null").select("seq", "symbol_idx", "side", "price", "d_size", "d_orders").collect()} == want
    rejects = {r.seq for r in lifecycle.rejects(states).collect()}
    told = out.where("reason is not null").collect()
    assert len(rejects) > 10 and {r.seq for r in told if r.reason != "late"} == rejects and [r.seq for r in told if r.reason == "late"] == [rows[0][1]]


def test_stream_of_golden_feed(spark):
    """Definitions come in-band, and no message but an add names its symbol."""
    msgs, defs = testfeed.golden_feed(spark)
    want = sorted(map(tuple, lifecycle.deltas(lifecycle.order_states(msgs)).select("seq", "symbol_idx", "side", "price", "d_size", "d_orders").collect()))
    rows = [(0, r.seq, r.feed_time, "S", r.symbol_idx, *[None] * 7, r.symbol, r.scale) for r in defs.collect()] + [(*r, None, None) for r in map(tuple, msgs.orderBy("seq").collect())]
    out = streamed(spark, (rows[:7], rows[7:]), ", symbol string, scale int")
    assert sorted(map(tuple, out.select("seq", "symbol_idx", "side", "price", "d_size", "d_orders").collect())) == want and len(want) == 19
    assert {(r.symbol_idx, r.symbol, r.scale) for r in out.collect()} == {(1968, "ken", 10), (1969, "wall", 100)}
