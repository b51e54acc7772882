"""Lexical search, whitening and personal data: brute force, SQL, planted cases, nulls, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderflow.llm import lexical, pii, whitening
from orderflow.llm.common import Scratch

SF = "/root/testdata/sf0.001"
CLASH = ("item", "score", "rank", "term", "df", "n", "row", "tf", "x", "dim", "count", "vec", "mean", "spans", "kind", "start", "component", "whitened", "deviation")


def wide(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))


# 11: ranked lexical search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k=10):
    from collections import Counter

    counts = [Counter(words(t)) for _, t in docs]
    size = [sum(c.values()) for c in counts]
    texts, total = sum(n > 0 for n in size), sum(size)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c, n in zip(docs, counts, size):
            m = 10 + 90 * n * texts // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


DOCS = [(i, " ".join(random.Random(i).choices(["alpha", "Beta", "gámma", "x1", "Ünï", "ab", "one-two", "omega"], k=i % 9))) for i in range(60)]
DOCS += [(5, "alpha beta"), (5, "alpha beta"), (None, "alpha beta"), (None, None), (100, ""), (101, " ,;!"), (102, "alpha " * 30_000), (103, "beta " * 30_000 + "ünï"), (-7, "alpha beta"), (2**63 - 1, "alpha beta")]
ITEMS = [(1, "Alpha beta!"), (1, "omega"), (2, "GÁMMA gámma Ünï"), (None, "x1 one two two"), (3, ""), (4, None), (5, "absent"), (6, " ".join(f"w{i}" for i in range(500)) + " alpha ab"), (7, "?!")]


@pytest.mark.parametrize("block, most, room", [(8192, 10_000, 16_000_000), (7, 2, 1), (64, 3, 5_000)])
def test_lexical_ranks(spark, monkeypatch, block, most, room):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ROOM", room)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs, items), (wide(docs), wide(items))):
        assert sorted(map(tuple, lexical.ranked(d, i, Scratch(spark, "t"), most=most).collect()), key=repr) == brute_ranks(DOCS, ITEMS)
    assert lexical.ranked(docs.limit(0), items, Scratch(spark, "t")).collect() == []
    assert lexical.ranked(docs, items.limit(0), Scratch(spark, "t")).collect() == []


def test_lexical_copies(spark):
    """A third of all rows is one text: ties far beyond k, by ascending id."""
    docs = [(i, "same words here") for i in range(900, 300, -1)] + [(i, f"word{i} here") for i in range(300)]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "words same"), (2, "word7 same")], "item_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(1, i + 1, 301 + i) for i in range(10)] + [(2, 1, 7)] + [(2, i + 2, 301 + i) for i in range(9)]


def test_bit_slices():
    rnd = np.random.default_rng(2)
    total = np.zeros((20, 40), np.uint64)
    plain = np.zeros(40 * 64, np.int64)
    for _ in range(30):
        cell = np.sort(rnd.choice(40, rnd.integers(1, 40), replace=False))
        values = rnd.integers(0, 2 ** int(rnd.integers(1, 15)), len(cell) * 64)
        bits = np.stack([np.packbits((values >> s & 1).astype(np.uint8), bitorder="little").view(np.uint64) for s in range(15)])
        lexical.add(total, cell, bits)
        plain[(cell[:, None] * 64 + np.arange(64)).ravel()] += values
    plain[rnd.integers(0, len(plain), 300)] = 0
    total = np.stack([np.packbits((plain >> s & 1).astype(np.uint8), bitorder="little").view(np.uint64) for s in range(20)])
    for k in (1, 10, 5000):
        ((_, rows, sums),) = lexical.best(total.reshape(20, 1, 40), k)
        want = sorted((-v, i) for i, v in enumerate(plain.tolist()) if v)[:k]
        assert sorted(zip((-sums).tolist(), rows.tolist())) == want


# 12: whitening


def test_eigen():
    rnd = np.random.default_rng(5)
    for a in [np.zeros((3, 3)), np.ones((4, 4)), np.diag([3.0, 3.0, 1.0, 0.0]), np.array([[2.0]]), *(x @ x.T for x in (rnd.normal(size=(n, n - 1)) for n in (2, 3, 9, 40)))]:
        values, vectors = whitening.eigen(a)
        scale = max(1.0, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * scale * len(a))
        assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13 * len(a)) and np.allclose(a @ vectors, vectors * values, atol=1e-12 * scale * len(a))


def test_merging_moments(spark):
    rnd = np.random.default_rng(6)
    x = rnd.integers(-50, 50, (403, 5)) + 1_000_000
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(40)
    m = whitening.moments(df, "x", 5, Scratch(spark, "t"), 1_000_000)
    assert m.n == 403 and m.sums == (x - 1_000_000).sum(axis=0).tolist()
    assert np.allclose(m.products / m.n, np.cov(x.T.astype(float) - 1e6, bias=True), rtol=1e-13) and np.allclose(m.mean, x.mean(axis=0) - 1e6, rtol=1e-13)


def test_whitening(spark):
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(80, 6)) @ rnd.normal(size=(6, 6))
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(3, base[3].tolist()), (None, base[4].tolist()), (200, base[5].tolist())] * 20
    bad = [(90, None), (91, [nan] + [0.0] * 5), (92, [inf] + [0.0] * 5), (93, [None] + [0.0] * 5), (94, [1.0, 2.0]), (95, []), (96, [1e30] + [0.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(distinct.T - 1e6, bias=True))
    e, u = e[::-1], u[:, ::-1]
    for frame in (df, wide(df)):
        got = whitening.whitened(frame, Scratch(spark, "t")).collect()
        assert len(got) == len(rows) * 6 and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
        want = {(i, c + 1, int(((n * v - sums) ** 2).sum())): w for (i, _), v, ws in zip(rows, x, (x - sums / n) @ u / np.sqrt(e)) for c, w in enumerate(ws)}
        assert {(r.vec_id, r.component, r.deviation) for r in got} == set(want)
        assert all(abs(abs(r.whitened) - abs(want[r.vec_id, r.component, r.deviation])) < 1e-6 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) for r in got)
        signs = {(r.component, np.sign(r.whitened * want[r.vec_id, r.component, r.deviation])) for r in got}
        assert len(signs) == 6
    assert whitening.whitened(df.limit(0), Scratch(spark, "t")).collect() == []
    assert whitening.whitened(df.where("vec_id = 200"), Scratch(spark, "t")).collect() == []
    flat = spark.createDataFrame([(0, [1.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 5.0])], "vec_id long, embedding array<float>")
    assert [(r.component, r.explained, round(r.whitened, 6)) for r in whitening.whitened(flat, Scratch(spark, "t")).where("vec_id = 2").collect()] in ([(1, 1.0, w)] for w in (1.336306, -1.336306))
    far = spark.createDataFrame([(0, [1e12, 0.0]), (1, [-1e12, 0.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(far, Scratch(spark, "t")).collect()} == {None}


# 13: personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    """The base spans by the patterns as they are given."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in re.sub("[^0-9]", "", m[0])]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and (not 13 <= len(digits) <= 19 or sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans():
    rnd = random.Random(3)
    for _ in range(8_000):
        text = "".join(rnd.choices(rnd.choice(["a@.-b1 ", "0123456789 -.", "+12 ().-a3", "a1@.+ (4-)é7", "012. 34-5"]), k=rnd.randrange(60)))
        assert sorted(pii.base_spans(text)) == plain_spans(text), text
        found = pii.spans(text)
        assert [s[:3] for s in found if s[4]] == plain_spans(text)
        assert not any(a is not b and not (a[4] and b[4]) and a[1] < b[2] and b[1] < a[2] for a in found for b in found), text


def test_added_spans():
    texts = {
        "pay to IBAN GB82 WEST 1234 5698 7654 32 AND go": [("iban", "GB82 WEST 1234 5698 7654 32")], "DE89370400440532013000.": [("iban", "DE89370400440532013000")], "DE89370400440532013001.": [], "DE8937040044053201300012": [],
        "call 555 867 5309 now": [("phone", "555 867 5309")], "the number 555 867 5309 is": [], "order 555 867 5309 call": [], "joe (at) example (dot) org": [("email", "joe (at) example (dot) org")],
        "card: 12 4111 1111 1111 1111 ok": [("card", "4111 1111 1111 1111")], "12 4111 1111 1111 1111 ok": [], "GB82 WEST 1234 5698 7654": [],
        "a.b.1.2.3.4.5.6.7.8.9.1.2.3.4.GB82WEST12345698765432@x.y": [("email", "a.b.1.2.3.4.5.6.7.8.9.1.2.3.4.GB82WEST12345698765432@x.y"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "9.1.2.3")],
    }
    for text, want in texts.items():
        assert [(pii.KINDS[k], text[a:b]) for k, a, b, _, _ in pii.spans(text)] == want
    near, far = pii.spans("card 4111-1111-1111-1111")[0], pii.spans("isbn 4111-1111-1111-1111")[0]
    assert near[3] == 1.0 and far[3] == 0.4 and near[4] and far[4]


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1", "+1((", "a@", "@a.", "1 ", "a@b.c@", "GB82 ", "(at) ", "@", "4111 1111 1111 1111 ", "12 34 ", "a@a-"])
def test_long_texts_take_linear_time(piece):
    import time

    began = time.process_time()
    pii.spans(piece * (300_000 // len(piece)))
    assert time.process_time() - began < 10


def test_personal_data(spark):
    rows = [(1, "é a@b.co 1.2.3.4"), (1, "é a@b.co 1.2.3.4"), (None, "+1 (988) 555-2485"), (2, None), (3, ""), (None, None), (4, "x" * 300_000 + " a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (df, wide(df)):
        got = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.value, s.base) for s in r.spans]) for r in pii.find(frame).collect()), key=repr)
        one = [("email", 2, 8, "a@b.co", True), ("ip", 9, 16, "1.2.3.4", True)]
        assert got == sorted([(1, one), (1, one), (None, [("phone", 0, 17, "+1 (988) 555-2485", True)]), (2, []), (3, []), (None, []), (4, [("email", 300_001, 300_007, "a@b.co", True)])], key=repr)
        assert sorted(r.text[-7:] for r in pii.redact(frame).where("text is not null").collect()) == sorted(["ail] [ip]"[-7:], "ail] [ip]"[-7:], "[phone]", "", "[email]"])
        assert pii.redact(frame).columns == frame.columns
    assert pii.find(df.limit(0)).collect() == []


def test_personal_data_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op13_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= {*r.spans.split(","), ""}
