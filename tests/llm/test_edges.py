"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from orderflow.llm import ann, chat, decontam, langid, linededup, mixing, ngram_join, quality, secrets, urlfilter
from orderflow.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 5000}" for i in range(200_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog\nsecond line here", "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog\nsecond line here", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog\nsecond line here", "en", "b", 1),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b ", None, None, None),
    (5, None, "de", None, None),
    (None, "der schnelle braune fuchs springt weit", "de", None, 3),
    (None, None, None, None, None),
    (6, "1234 5678 !!", "en", "a", 1),
    (7, LONG, "en", "c", 1),
    (8, LONG, None, "c", 1),
    (9, "der schnelle braune fuchs springt hoch", "de", "", 3),
]
#: Names that operators use inside.
CLASH = ("key", "node", "size", "row", "n", "line", "words", "score", "lang_pred", "text_key", "part", "block", "_pid", "target", "taken", "dropped", "n_dropped", "_low", "_letter", "value", "label", "rank", "root", "range", "_id", "trusted", "host", "path", "rest")


@pytest.fixture(scope="session", params=["plain", "clashing", "empty"])
def docs(request, spark):
    df = spark.createDataFrame([] if request.param == "empty" else ROWS, DOCS)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)) if request.param == "clashing" else df


def scratch(spark):
    return Scratch(spark, "edges")


def test_secrets(spark, docs):
    out = secrets.scan(docs.unionByName(docs.limit(2).withColumn("text", F.lit("token = aB3dE6gH9jK2mN5p")).withColumn("doc_id", F.lit(None).cast("long"))), scratch(spark)).collect()
    assert [(r.doc_id, r.value) for r in out] == [(None, "aB3dE6gH9jK2mN5p")] * min(2, docs.count())


def test_groups(spark, docs):
    out = ngram_join.jaccard_groups(docs, scratch(spark)).collect()
    assert len(out) == docs.count()
    if out:
        by = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
        assert by >= {(1, 9, 1), (2, 9, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 5000, 7), (8, 5000, 7), (None, 0, None), (None, 3, None)}


def test_mix(spark, docs):
    out = mixing.mix(docs, scratch(spark)).collect()
    assert len(out) == docs.count() and all(r.size == 0 and r.taken == 0 for r in out if r.doc_id in (3, 4, 5))
    assert all(r.taken <= 2 * r.size for r in out)
    if out:
        assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r.size for r in out), abs=4)


def test_chat(spark):
    rows = [(1, 0, "user", "hi?"), (1, 0, "user", "hi?"), (1, 1, "assistant", None), (None, 0, "user", "lost"), (2, None, "tool", "x\n\ny"), (2, 1, None, ""), (3, 0, "user", "\n".join(["a line of text."] * 5000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.select("*", *(F.lit(1).alias(c) for c in ("state", "line", "pos", "range", "n", "gap", "first", "begins")))
    for frame in (df, wide):
        out = chat.format_conversations(frame, scratch(spark)).collect()
        assert {r.conv_id for r in out} == {1, 2, 3, None} and sum(r.n_lines for r in out) == 2 + 1 + 2 + 5000
    assert chat.format_conversations(df.limit(0), scratch(spark)).collect() == []


def test_language(spark, docs):
    out = langid.identify(docs).collect()
    assert len(out) == docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (3, 4, 5, 6)) and all(0 <= r.score <= 1 for r in out)
    kept = langid.predict(docs, langid.fit(docs))
    assert set(kept.columns) == {*docs.columns, "lang_pred", "score"} and kept.count() == docs.count()
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" for r in nothing)


def test_quality(spark, docs):
    ids = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    out = quality.judge(docs, ids, scratch(spark)).collect()
    assert len(out) == docs.count() and all(r.perplexity is None and not r.keep for r in out if r.doc_id in (3, 5))
    assert all(r.keep for r in out if r.doc_id in (1, 2, 9))
    none = quality.judge(docs, ids.limit(0), scratch(spark)).collect()
    assert all(r.limit is None and (r.perplexity is None or r.perplexity == pytest.approx(64)) for r in none)


def test_urls(spark):
    urls = ["http://www.Example.com/en/x?q#f", "https://a.example.com/en/1", "http://example.com", "ftp://b.net/es/", "http://b.net/ES/", "no scheme", "http://", "x://y?z://w", None]
    want = [("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"), ("example.com", "", None), ("b.net", "/es/", "net/es/", "block"), ("b.net", "/ES/", None), ("", "", None), ("", "", None), ("y", "", None), ("", "", None)]
    pages = spark.createDataFrame([(i, u, '<a href="//b.net/x">' if i % 2 else None) for i, u in enumerate(urls)] + [(None, None, None), (0, urls[0], None)], "page_id long, url string, html string")
    for frame in (pages, pages.select("*", *(F.lit(1).alias(c) for c in ("host", "path", "rule", "rank", "src", "trust")))):
        out = urlfilter.judge_urls(frame, scratch(spark)).collect()
        assert len(out) == len(urls) + 2
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
        assert all(got[i][: len(w)] == w for i, w in enumerate(want)) and got[4][3] == "block" and got[None][3] == "allow"
    assert urlfilter.judge_urls(pages.limit(0), scratch(spark)).collect() == []


def test_decontamination(spark, docs):
    item = "brown fox jumps over the lazy dog\nsecond line"
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, ""), (3, None), (4, "fuchs")], "item_id long, text string")
    got = sorted((r.doc_id, -9 if r.item_id is None else r.item_id) for r in decontam.contaminated(docs, items).where("item_id is null or item_id <> 4").collect())
    assert got == (sorted([(1, -9), (1, 1), (1, 1)] * 2 + [(2, -9), (2, 1), (2, 1)]) if docs.count() else [])
    left = decontam.clean(docs, items.where("item_id = 1"))
    assert left.columns == docs.columns and left.where("doc_id in (1, 2)").count() == 0 and left.count() == max(0, docs.count() - 3)
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for frame in (df, df.select("*", *(F.lit(1).alias(c) for c in ("id", "vec", "leaf", "rank", "score")))):
        out = sorted(map(tuple, ann.nearest(frame, scratch(spark), share=9.0).collect()))
        assert out == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 2, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert ann.nearest(df.limit(0), scratch(spark)).collect() == []


def test_lines(spark, docs):
    out = linededup.dedup_lines(docs, scratch(spark))
    assert set(docs.columns) <= set(out.columns)
    got = sorted(((r.doc_id or 0), r.text, r.n_lines, r.n_dropped) for r in out.select("doc_id", F.coalesce("text", F.lit("null")).alias("text"), "n_lines", "n_dropped").collect())
    assert len(got) == docs.count()
    if got:
        assert [g[3] for g in got if g[0] == 1] == [0, 0] and [g[1:] for g in got if g[0] == 2] == [("", 2, 2)] and [g[3] for g in got if g[0] in (7, 8)] == [0, 1]
        assert [g[1] for g in got if g[0] in (3, 4, 5)] == ["", " \t\n\x0b ", "null"]
