"""Books over time and kept tables: brute force on random flows, pruned files, rewritten folders, plans without a shuffle of the table."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_feed import BIG, MSGS, flow

from orderflow.operators import bbo, kept, levels, lifecycle, matching


@pytest.fixture(scope="module")
def states(spark):
    """Two lines with few prices, so that queues are long, and all kinds of messages."""
    rows = [(*r[:9], r[9] // 4000 * 4000, *r[10:]) for seed in (3, 4) for r in flow(random.Random(seed), 500, line=seed - 3)]
    msgs = spark.createDataFrame([(*r[:2], r[2] * 2 + r[0], *r[3:]) for r in rows], MSGS).withColumn("match_num", F.lit(None).cast("long"))
    msgs = msgs.withColumns({c: F.when(F.col("msg_type") == "A", F.col(c)) for c in ("symbol_idx", "side")})  # other messages name an order only
    return lifecycle.order_states(msgs).persist()


def lives(states):
    """(level, priority, first seq, last seq, id, size) of each state of an order, and all changes of any."""
    chains = {}
    for r in sorted(states.where("reason is null").collect(), key=lambda r: r.seq):
        chains.setdefault((r.line_id, r.chain), []).append(r)
    out = []
    for rows in chains.values():
        for r, after in zip(rows, [*rows[1:], None]):
            if r.rem > 0:
                out.append(((r.symbol_idx, r.side, r.price), r.priority_seq, r.seq, after.seq if after else 2**60, r.new_order_id if r.msg_type == "R" else r.order_id, r.rem))
    return out


@pytest.mark.parametrize("width", [65_536, 64, 7])
def test_queue_over_time(states, width):
    held = lives(states)
    want = []
    for level, priority, seq, _, oid, size in held:
        ahead = [o for o in held if o[0] == level and o[1] < priority and o[2] <= seq < o[3]]
        want.append((seq, oid, *level, size, len(ahead) + 1, sum(o[5] for o in ahead)))
    got = sorted(map(tuple, levels.queue_timeline(states, width).collect()))
    assert got == sorted(want) and max(r[6] for r in got) > 5 and any(r[1] > BIG for r in got)


def test_best_prices_from_nodes(states):
    history = levels.history(lifecycle.deltas(states)).persist()
    got = bbo.timeline_by_nodes(history)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, bbo.timeline(history).collect()), key=repr)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan.split("Physical Plan")[1].split("InMemoryTableScan")[0]
    assert bbo.timeline_by_nodes(history.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 37, 5_000])
def test_snapshots_at_any_seq(spark, states, tmp_path, width):
    deltas = lifecycle.deltas(states).persist()
    index = kept.index_snapshots(deltas, str(tmp_path / "index"), width)
    seqs = [0, 1, 36, 37, 38, 400, 999, 1_001, 10**6] if width > 1 else [5, 700]
    names = [*levels.LEVEL, "agg_size", "num_orders"]
    want = {s: sorted(map(tuple, levels.snapshot(deltas, s).select(names).collect())) for s in seqs}
    if width > 1:
        for s in seqs[:8]:
            assert sorted(map(tuple, index.at(s).collect())) == want[s], s
    many = index.at_many(spark.createDataFrame([(s,) for s in seqs] + [(seqs[0],)], "at_seq long")).collect()
    last = deltas.agg(F.max("seq")).first()[0]
    for s in seqs:
        assert sorted(tuple(r)[1:] for r in many if r.at_seq == s) == (want[s] if s // width <= last // width else []), s
    if width == 37:  # one folder of each kind is read
        plan = index.at(400)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [isnotnull(bucket") == 2


def test_sweeps_in_spans(spark):
    """Aggressors added up in small spans of seq fill as those added up at once."""
    rnd = random.Random(8)
    orders = spark.createDataFrame([(i % 3, "BS"[i % 2], i, rnd.randrange(9), rnd.randrange(1, 60), i) for i in range(300)], "symbol_idx int, side string, order_id long, price long, size long, priority_seq long")
    takers = spark.createDataFrame([(i % 3, rnd.choice("BS"), i * 5, rnd.randrange(90)) for i in range(120)], "symbol_idx int, side string, seq long, quantity long")
    whole = sorted(map(tuple, matching.sweep_many(orders, takers).collect()))
    assert whole and all(sorted(map(tuple, matching.sweep_many(orders, takers, 50, span).collect())) == whole for span in (1, 17))


def folders(spark, table):
    """Files of each folder of the table."""
    root = spark.sql(f"DESCRIBE FORMATTED {table.name}").where("col_name = 'Location'").first()["data_type"].removeprefix("file:")
    return {d: sorted(f for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet")) for d in os.listdir(root) if d.startswith("part=")}


def test_keyed_table(spark):
    table = kept.KeyedTable(spark, "kept_test", "id", parts=8, buckets=4)
    spark.sql("DROP TABLE IF EXISTS kept_test")
    table.create(spark.range(200).select("id", F.col("id").cast("string").alias("v")))
    all_rows = lambda: dict(map(tuple, table.read().collect()))
    held = {i: str(i) for i in range(200)}
    before = folders(spark, table)
    new = spark.createDataFrame([(5, "x", 1), (1_000, "late", 2), (1_000, "first", 1), (None, "lost", 1)], "id long, v string, n int")
    assert sorted(map(tuple, table.insert_absent(new, "n").collect())) == [(5, False), (1_000, True)]
    assert all_rows() == (held := held | {1_000: "first"})
    after = folders(spark, table)
    assert sum(before[d] != after[d] for d in before) == 1  # one key, one folder
    assert sorted(map(tuple, table.insert_absent(new, "n").collect())) == [(5, False), (1_000, False)]
    assert folders(spark, table) == after and all_rows() == held  # a rerun changes nothing
    gone = spark.createDataFrame([(7,), (7,), (9_999,), (None,)], "id long")
    assert sorted(map(tuple, table.erase(gone).collect())) == [(7, True), (9_999, False)]
    assert all_rows() == (held := {k: v for k, v in held.items() if k != 7})
    assert sorted(map(tuple, table.erase(gone).collect())) == [(7, False), (9_999, False)]
    part = table.read().select("id", table._part()).where("part = 3")
    ids = [r.id for r in part.collect()]
    assert ids and table.erase(part.select("id")).where("erased").count() == len(ids)
    assert all_rows() == {k: v for k, v in held.items() if k not in ids}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = spark.range(1_000).repartition(3).join(table.read(), "id")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.rindex("Exchange") :]
    assert "Bucketed: true" in plan and "kept_test" not in side.split("Range")[0]
    spark.sql("DROP TABLE kept_test")
