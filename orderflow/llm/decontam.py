"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items, pruned as in WAND.

Test items are the indexed texts, passages the queries. A score is taken relative to what an item must reach, so that
1 is the threshold of every item. A batch of passages is pruned first by the sum of its terms' greatest impacts (the
WAND bound), then block of items by block of items by the greatest impacts there (block-max), and what may reach 1 is
scored exactly. What reaches it is verified: the question's word 5-grams and the answer's words must stand in the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: A passage is two neighbouring steps of STEP words; the next one begins a step later.
STEP = 64
#: Share of an item's own BM25 score that a passage must reach; an item longer than a step is held to a step's part.
SHARE = 0.5
#: Least share of the question's 5-grams; of the answer's words; and of 5-grams that tell without the answer.
QUESTION, ANSWER, ALONE = 0.5, 0.5, 0.8
GRAM, BLOCK, K1, B = 5, 16, 1.2, 0.75
#: Items in one index, which is broadcast; more items make more indexes, of which PASS are asked in one scan of the corpus.
ITEMS, PASS = 20_000, 4


def plain(texts: pa.Array) -> pa.Array:
    """Lower-cased in all scripts, every run of signs one space; items and passages are compared in this form."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", " ")


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] ... starts[i] + counts[i] - 1, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Index:
    """Postings by term and block of items, with the greatest impact of each block and term.

    ``overall`` holds what counts over the items of all indexes: their number, mean length, and the items of each term (sorted
    hashes and counts). Without it these items are all.
    """

    def __init__(self, ids: list[int | None], texts: list[str], overall: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        with np.errstate(over="ignore"):
            hashes, at = tokens.words(plain(pa.array(texts, pa.string())))
            parts = [re.split(r"\n", t.strip()) for t in texts]
            parts = [p if len(p) > 1 else re.split(r"(?<=[.!?])\s+", p[0]) for p in parts]
            answers, answer_at = tokens.words(plain(pa.array([p[-1] if len(p) > 1 else "" for p in parts], pa.string())))
            question, question_at = tokens.words(plain(pa.array(["\n".join(p[:-1] or p) for p in parts], pa.string())))
            self.grams = list(tokens.shingles(question, question_at, GRAM))
        self.answers = [np.unique(answers[a:b]) for a, b in zip(answer_at[:-1], answer_at[1:])]
        self.short = np.minimum(np.diff(question_at), GRAM)
        self.ids, self.long = pa.array(ids, pa.int64()), np.diff(at)
        item = np.repeat(np.arange(len(ids)), self.long)
        self.terms, term = np.unique(hashes, return_inverse=True)
        pair, tf = np.unique(item * max(1, len(self.terms)) + term, return_counts=True)
        item, term = np.divmod(pair, max(1, len(self.terms)))
        if overall is None:
            overall = len(ids), self.long.mean() if len(ids) else 1.0, self.terms, np.bincount(term, minlength=len(self.terms))
        items, mean, known, df = overall
        df = df[np.searchsorted(known, self.terms)]
        idf = np.log(1 + (items - df + 0.5) / (df + 0.5))
        mean = max(1.0, mean)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.long[item] / mean))
        self.goal = SHARE * np.bincount(item, impact, len(ids)) * np.minimum(1, STEP / np.maximum(1, self.long))
        impact = impact / np.maximum(self.goal[item], 1e-12)
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], impact[order], term[order]
        key = term * (len(ids) // BLOCK + 1) + self.item // BLOCK
        self.run = np.flatnonzero(np.diff(key, prepend=-1))  # where a block of a term begins
        self.run_n = np.diff(self.run, append=len(key))
        self.run_block = self.item[self.run] // BLOCK
        self.run_max = np.maximum.reduceat(self.impact, self.run) if len(key) else np.zeros(0)
        self.term_run = np.searchsorted(term[self.run], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.impact, np.searchsorted(term, np.arange(len(self.terms)))) if len(key) else np.zeros(0)

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, first word of the passage and relative score of all that reach 1; ``at`` as from tokens.words."""
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.terms):
            return none, none, none, np.zeros(0)
        place = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == hashes)
        steps = np.maximum(1, -(-np.diff(at) // STEP))
        first = np.concatenate([[0], np.cumsum(steps)])
        text = np.searchsorted(at, hit, side="right") - 1
        step, n = first[text] + (hit - at[text]) // STEP, len(self.terms)
        pairs = np.unique(step * n + place[hit])
        owner, term = np.divmod(pairs, n)
        back = owner > first[np.searchsorted(first, owner, side="right") - 1]  # also in the passage that begins a step earlier
        pairs = np.unique(np.concatenate([pairs, pairs[back] - n]))
        passage, term = np.divmod(pairs, n)
        bound = np.bincount(passage, self.term_max[term], first[-1])
        live = bound[passage] >= 1
        passage, term = passage[live], term[live]
        runs = _expand(self.term_run[term], self.term_run[term + 1] - self.term_run[term])
        passage = np.repeat(passage, self.term_run[term + 1] - self.term_run[term])
        blocks = len(self.ids) // BLOCK + 1
        which, back = np.unique(passage * blocks + self.run_block[runs], return_inverse=True)
        live = (np.bincount(back, self.run_max[runs], len(which)) >= 1)[back] if len(which) else np.zeros(0, bool)
        passage, runs = passage[live], runs[live]
        posts = _expand(self.run[runs], self.run_n[runs])
        which, back = np.unique(np.repeat(passage, self.run_n[runs]) * len(self.ids) + self.item[posts], return_inverse=True)
        score = np.bincount(back, self.impact[posts], len(which)) if len(which) else np.zeros(0)
        which, score = which[score >= 1 - 1e-9], score[score >= 1 - 1e-9]
        passage, item = np.divmod(which, len(self.ids))
        text = np.searchsorted(first, passage, side="right") - 1
        return text, item, at[text] + (passage - first[text]) * STEP, score

    def verify(self, hashes: np.ndarray, lo: int, hi: int, item: int) -> tuple[float, float]:
        """Shares of the item's question (5-grams) and answer (words) in the words lo to hi."""
        span, k = hashes[lo:hi], int(self.short[item])
        here = next(iter(tokens.shingles(span, np.array([0, len(span)]), k))) if k and len(span) >= k else span[:0]
        if 0 < k < GRAM and len(span) >= k:  # a shorter question is one gram of all its words
            here = np.array([tokens.mix64((span[i : i + k] * tokens._PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k) * tokens._PLACE[15])[0] for i in range(len(span) - k + 1)], np.uint64)
        grams, answer = self.grams[item], self.answers[item]
        q = np.isin(grams, here).mean() if len(grams) else 0.0
        a = np.isin(answer, span).mean() if len(answer) else 1.0
        return float(q), float(a)

    def matches(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> best relative score, question share, answer share of all that verify."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        with np.errstate(over="ignore"):
            hashes, at = tokens.words(plain(texts))
            for text, item, start, score in zip(*(x.tolist() for x in self.candidates(hashes, at))):
                more = max(0, int(self.long[item]) - STEP)
                q, a = self.verify(hashes, max(int(at[text]), start - more), min(int(at[text + 1]), start + 2 * STEP + more), item)
                if q >= QUESTION and (a >= ANSWER or q >= ALONE):
                    was = out.get((text, item), (0.0, 0.0, 0.0))
                    out[text, item] = (max(was[0], score), max(was[1], q), max(was[2], a))
        return out


def _terms(batches):
    """Distinct words of each item, and the item's length with its first one."""
    for batch in batches:
        with np.errstate(over="ignore"):
            hashes, at = tokens.words(plain(batch.column("text")))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = np.unique(hashes[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.where(np.arange(len(own)) == 0, b - a, 0))], ["term", "long"])


def indexes(benchmark: DataFrame, items: int = ITEMS):
    """Broadcast indexes, with the copies of their items, of about ``items`` distinct items each (item_id, text).

    Items without words are left out, and copies of an item are held once. One index at a time is in the driver's memory.

    Lengths and the items of a term are counted over the whole benchmark, so scores do not depend on ``items``.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    terms = rows.select("text").mapInArrow(_terms, "term long, long long").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("long").alias("long"))
    n = rows.count()
    single = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    shards = max(1, -(-single.count() // items))
    total = terms.agg(F.sum("long")).first()[0] or 0
    for shard in range(shards):
        part = single.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        held = part.orderBy("item_id", "text").collect()
        mine = part.select("text").mapInArrow(_terms, "term long, long long").select("term").distinct()
        table = terms.join(mine, "term", "left_semi").select("term", "df").toPandas()  # bounded by the words of a shard
        known = table["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(known)
        overall = (n, total / max(1, n), known[order], table["df"].to_numpy(np.int64)[order])
        yield spark.sparkContext.broadcast((Index([r["item_id"] for r in held], [r["text"] for r in held], overall), np.array([r["copies"] for r in held], np.int64)))


def passes(benchmark: DataFrame, items: int):
    """Lists of PASS indexes."""
    held = list(indexes(benchmark, items))
    return [held[i : i + PASS] for i in range(0, len(held), PASS)]


def contaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, score, question, answer: every item of ``benchmark`` found in a row of ``docs`` (doc_id, text).

    score is the best passage's BM25 score divided by the item's threshold (1 or more); question and answer are the
    shares of the item's 5-grams and last sentence (its last line, if it has several) that stand around the passage.

    Words are compared lower-cased in all scripts, and signs separate them. Null, empty or wordless texts and items match
    nothing. Null doc_id or item_id: the row comes with null.
    Repeated rows and repeated items match each on their own. Empty tables give no rows. Other columns are not read.
    Texts of any length are cut into passages as a whole.
    """
    out = None
    for asked in passes(benchmark, items):

        def run(batches, asked=asked):
            for batch in batches:
                for part in tokens.slices(batch, "text"):
                    for held in asked:
                        index, copies = held.value
                        found = index.matches(part.column("text"))
                        at = np.array(list(found), np.int64).reshape(-1, 2)
                        told = np.array(list(found.values()), np.float64).reshape(-1, 3)
                        at, told = np.repeat(at, copies[at[:, 1]], axis=0), np.repeat(told, copies[at[:, 1]], axis=0)
                        columns = [part.column("doc_id").take(pa.array(at[:, 0])), index.ids.take(pa.array(at[:, 1]))]
                        columns += [pa.array(told[:, j]) for j in range(3)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question", "answer"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question double, answer double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``contaminated`` finds nothing; its cases hold here as well.

    Rows with a null or wordless text stay, and repeated rows stay or go together.
    """
    for asked in passes(benchmark, items):

        def run(batches, asked=asked):
            for batch in batches:
                for part in tokens.slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    for index in asked:
                        keep[[t for t, _ in index.value[0].matches(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
