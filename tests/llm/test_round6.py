"""Findings of the check after round 5 (FINDINGS_r03)."""

import numpy as np
from pyspark.sql import functions as F

from orderflow.llm import linededup
from orderflow.llm.common import Scratch

LINE = "seven longer words stand within this single line together with several others"


def test_op10_votes_stay_within_the_row(spark):
    """words were exploded and their votes added over rows, so that a row that stands twice voted twice and lost its links."""
    docs = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE + " again")], "doc_id long, text string")
    keys = {(r.doc_id, tuple(r["keys"])) for r in linededup.signatures(docs).where("down = 0").collect()}
    assert len({k for i, k in keys if i == 1}) == 1
    assert {(i, k) for i, k in keys if i == 1} == {(r.doc_id, tuple(r["keys"])) for r in linededup.signatures(docs.distinct()).where("doc_id = 1 and down = 0").collect()}
    plan = linededup.signatures(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    out = {(r.doc_id, r.n_dropped) for r in linededup.dedup_lines(docs, Scratch(spark, "t")).collect()}
    assert out == {(1, 0), (2, 1)}


def test_op10_majority_of_any_number_of_votes(spark):
    rnd = np.random.default_rng(3)
    votes = [[int(v) for v in rnd.integers(-(2**63), 2**63, n)] for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 300, 5000]]
    got = [r.m for r in spark.createDataFrame(list(enumerate(votes)), "i int, v array<long>").orderBy("i").select(linededup.majority(F.col("v")).alias("m")).collect()]
    assert got == [sum((2 * sum(v >> i & 1 for v in vs) > len(vs)) << i for i in range(32)) for vs in votes]


def test_op10_rounds_of_a_few_pairs_are_left_to_the_last_step(spark):
    """each round cost plans and broadcasts on the driver, though on most tables it verified a few dozen pairs."""
    n = 150  # sketches of all but two lines are far apart
    far = [[int(v) for v in np.random.default_rng(i).integers(-(2**63), 2**63, 2)] for i in range(n)]
    rows = [(i, 100, 3, [7], far[i // 2 * 2]) for i in range(n)]
    spots = spark.createDataFrame(rows, "node long, long int, k int, keys array<long>, sketch array<long>")
    calls = []

    def verify(pairs, room):
        calls.append(pairs.count())
        return pairs

    roots = {r.node: r.root for r in linededup.linked_lines(spots, verify, Scratch(spark, "t")).collect()}
    assert len(calls) == 2 and all(roots[i] == roots[i + 1] for i in range(0, n, 2)) and len(set(roots.values())) == n // 2
