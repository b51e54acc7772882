"""Findings of round 3."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orderflow.llm import ann, common, linededup


def test_op2_pair_of_many_keys_is_formed_once(spark):
    """two nodes that share 40 keys, and two that share each tenth of theirs, were formed once for each shared key."""
    posts = [(k, n, k) for n in (1, 2) for k in range(40)] + [(k if k % 10 == 0 else 1000 * n + k, n, k) for n in (3, 4) for k in range(100, 140)]
    rows = spark.createDataFrame(posts, "key long, node long, place long")
    before = [F.lag("key", i + 1).over(W.partitionBy("node").orderBy("place")).alias(f"before{i}") for i in range(common.BEFORE)]
    rows = rows.select("*", F.col("node").alias("root"), *before)
    out = common.pairs_across(rows.select("key", F.struct("node", "root", "place", *(f"before{i}" for i in range(common.BEFORE))).alias("one")), lambda x, y: F.lit(True))
    assert sorted((r.a, r.b) for r in out.collect()) == [(1, 2)] + [(3, 4)] * 4


def test_op9_block_puts_out_its_best_only():
    """each leaf put out 20 rows a query, so that rows grew with queries times leaves."""
    rng = np.random.default_rng(3)
    x, leaves = rng.normal(size=(300, 8)), rng.integers(0, 10, (300, 2)) + [0, 10]
    rows = pd.DataFrame({"id": np.arange(300), "vec": list(x), "leaves": list(leaves)})
    asked = rows.iloc[:40].assign(leaves=[[0, 3, 12, 19]] * 40)
    block = ann.Block(asked, 20, 5)
    for i in range(0, 300, 70):
        block.meet(rows.iloc[i : i + 70])
    out = block.table()
    assert len(out) == 40 * 5
    inside = np.isin(leaves, [0, 3, 12, 19]).any(axis=1)
    for q, got in out.groupby("query_id"):
        score = np.where(inside & (np.arange(300) != q), x @ x[q], -np.inf)
        assert got["vec_id"].tolist() == np.argsort(-score)[:5].tolist()


def linked(spark, pairs):
    """Share of the pairs of lines of which the second was dropped; pairs do not resemble each other."""
    docs = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), common.Scratch(spark, "t")).where("n_dropped > 0").collect()
    assert all(r.doc_id % 2 for r in out)
    return len(out) / len(pairs)


def test_op10_lines_meet_across_the_ways_to_read_them(spark):
    """lines of 8 words and the same without a short one were read in two ways and never met; lines of short words had no key."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + i) for i in rng.integers(0, 26, n))
    fewer, short, longer = [], [], []
    for _ in range(40):
        w = [word(int(n)) for n in rng.integers(5, 9, 8)]
        w[4] = word(2)
        fewer.append((" ".join(w), " ".join(w[:4] + w[5:])))
        w = [word(3) for _ in range(20)]
        short.append((" ".join(w), " ".join(w[:9] + [word(3)] + w[10:])))
        w = [word(21) for _ in range(12)]
        w[0], w[5] = word(19), word(12)
        longer.append((" ".join(w), " ".join(w[:5] + w[6:])))
    got = [linked(spark, pairs) for pairs in (fewer, short, longer)]
    assert min(got) >= 0.9, got
