"""Secret scans: candidates by shape, a random forest trained on labelled findings to remove false positives."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch
from .linededup import let

#: A candidate is a run of LONG or more characters of VALUE with a digit, or one of SHORT or more after a credential's name.
LONG, SHORT = 16, 8
VALUE = r"[A-Za-z0-9+/\\@&%$!~_.-]+=*"
#: The forest is fitted on at most so many distinct findings of each label, those with the smallest hashes.
TRAIN, TREES, DEPTH = 2_500, 20, 5
#: A letter run counts as a dictionary word from so many occurrences as a word of the corpus.
KNOWN = 5
#: Up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Of neighbouring words, so many characters are held, from the side next to the candidate.
NEXT = 64
#: Formats that tell a label are looked for in values of so many characters at most; longer ones have no label.
FORMAT = 1_000
CREDENTIAL = r"(?i)(pass|pwd|secret|token|key|auth|credential|bearer|login)"
#: Classes of characters for transitions: a to z, digits, all others.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "transition", "switches", "digits", "uppers", "others", "distinct", "hex", "coverage", "path", "address", "named", "assigned")


def values(word: Column) -> Column:
    """Distinct values of a word in an array of (value, nth, ahead), of each its first place.

    A word is cut at its values once. ahead is what stands before a value, back to the start of the value before the last
    one, so an array grows with the word's length and no more.
    """
    found = F.regexp_extract_all(word, F.lit(f"({VALUE})"), F.lit(1))
    gaps = F.split(word, VALUE)

    def each(s: Column) -> Column:
        at = lambda i, name: F.when(i >= 0, F.get(s[name], i)).otherwise("")
        edge = lambda v: F.regexp_extract(v, "^[.&%!-]+", 0)
        ahead = lambda v, i: F.concat(at(i - 1, "gaps"), at(i - 2, "found"), at(i - 1, "gaps"), at(i - 1, "found"), at(i, "gaps"), edge(v))
        bare = lambda v: F.regexp_replace(v, r"^[.&%!-]+|[.&!-]+$", "")
        return F.array_sort(F.transform(s["found"], lambda v, i: F.struct(bare(v).alias("value"), i.alias("nth"), ahead(v, i).alias("ahead"))))

    several = let(F.struct(found.alias("found"), gaps.alias("gaps")), each)
    return let(several, lambda rows: F.filter(rows, lambda r, i: (F.length(r["value"]) >= SHORT) & ((i == 0) | (F.get(rows, F.greatest(i - 1, F.lit(0)))["value"] != r["value"]))))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, at, link, before, after, value, named, assigned: every candidate with its word number and neighbours.

    A word may hold several values, as in code or minified JSON; named is the value or two before it in its word, or the
    word before, if that is a credential's name. link: the word begins with a scheme. before and after hold NEXT
    characters at most.
    """
    words = F.split("text", f"[{SPACES}]+")
    plain = F.sequence(F.lit(0), F.size("words") - 1)
    word = lambda i: F.get("words", i)
    long = F.filter(plain, lambda i: (F.length(word(i)) >= SHORT) & ((F.length(word(i)) >= LONG) & word(i).rlike("[0-9]") | (i > 0) & word(i - 1).rlike("[:=]$") & word(i - 1).rlike(CREDENTIAL) | word(i).rlike("[:=]") & word(i).rlike(CREDENTIAL)))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words.alias("words")).where(F.col("text").isNotNull())
    before = lambda i: F.right(F.array_join(F.slice("words", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " "), F.lit(NEXT))
    near = F.transform(long, lambda i: F.struct(i.alias("at"), word(i).rlike("^[a-z]+://").alias("link"), before(i).alias("before"), F.left(F.array_join(F.slice("words", i + 2, 2), " "), F.lit(NEXT)).alias("after"), values(word(i)).alias("values")))
    found = found.select("doc_id", "text_key", F.explode(near).alias("f")).select("doc_id", "text_key", "f.*")
    found = found.select("*", F.explode("values").alias("v")).select("doc_id", "text_key", "at", "link", "before", "after", "v.*")
    told = F.col("ahead").rlike("[:=]")
    found = found.withColumn("named", F.when(told, F.col("ahead").rlike(CREDENTIAL)).otherwise(F.concat_ws(" ", F.when(F.col("nth") < 2, F.col("before")), "ahead").rlike(CREDENTIAL)))
    found = found.withColumn("assigned", F.col("ahead").rlike(r"""[:=]["'`]?$""") | ((F.col("nth") == 0) & F.col("ahead").rlike(r"""^["'`]?$""") & F.col("before").rlike("[:=]$")))
    long_enough = (F.length("value") >= LONG) & F.col("value").rlike("[0-9]")
    return found.where(long_enough | ((F.length("value") >= SHORT) & F.col("named") & F.col("assigned"))).drop("nth", "ahead")


def transitions(words: DataFrame) -> list[float]:
    """Log probability of a character class after another, in (word, n): 28 x 28 values, smoothed by one."""
    size = len(LETTERS) + 2
    code = lambda c: F.when(F.instr(F.lit(LETTERS), c) > 0, F.instr(F.lit(LETTERS), c)).when(c.rlike("[0-9]"), size - 1).otherwise(size)
    pairs = words.where("length(word) > 1").select("n", F.explode(F.regexp_extract_all("word", F.lit("(?s)(?=(..))"), F.lit(1))).alias("two"))
    pairs = pairs.groupBy("two").agg(F.sum("n").alias("n")).select("n", code(F.substring("two", 1, 1)).alias("a"), code(F.substring("two", 2, 1)).alias("b"))
    counts = [[1.0] * size for _ in range(size)]
    for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most 28 * 28 rows
        counts[r["a"] - 1][r["b"] - 1] += r["n"]
    return [math.log(n / sum(row)) for row in counts for n in row]


def mean_transition(value: Column, table: list[float]) -> Column:
    """Mean log probability of the steps from one character to the next."""
    size = len(LETTERS) + 2
    chars = F.split(F.lower(value), "")
    codes = F.transform(chars, lambda c: F.when(F.instr(F.lit(LETTERS), c) > 0, F.instr(F.lit(LETTERS), c)).when(c.rlike("[0-9]"), size - 1).otherwise(size))
    steps = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.element_at(F.array(*map(F.lit, table)), ((a - 1) * size + b).cast("int")))
    return F.when(F.size(codes) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / (F.size(codes) - 1))


def with_features(found: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds FEATURES to ``findings``; transitions and coverage are learned from the words of all ``docs``.

    Words are counted before anything is joined, so what is joined is bounded by the vocabulary.
    """
    spoken = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    spoken = scratch.write(spoken.where(F.col("n") >= KNOWN), "spoken")
    table = transitions(spoken)
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9"), "[^aA9]+", "-")
    found = found.select(
        "doc_id", "text_key", "at", "link", "before", "after", "value", F.length(value).cast("double").alias("length"), mean_transition(value, table).alias("transition"), ((F.length(shape) - 1) / n).alias("switches"),
        share("[^0-9]").alias("digits"), share("[^A-Z]").alias("uppers"), share("[A-Za-z0-9]").alias("others"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct"), value.rlike("^[0-9a-fA-F]+$").cast("double").alias("hex"),
        value.rlike(r"[/\\]|\.[a-z]{2,4}$").cast("double").alias("path"), F.instr(value, "@").cast("boolean").cast("double").alias("address"),
        F.col("named").cast("double").alias("named"), F.col("assigned").cast("double").alias("assigned"),
        F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("runs"),
    )
    runs = scratch.write(found.select(F.explode("runs").alias("run")).distinct(), "runs")
    wanted = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    known = scratch.write(spoken.select(F.col("word").alias("run")).join(wanted, "run", "left_semi"), "known")
    covered = found.select("value", F.explode("runs").alias("run")).distinct().join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    return found.join(covered, "value", "left").withColumn("coverage", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.greatest(F.length("value"), F.lit(1)))).drop("runs", "covered")


def label_by_format(found: DataFrame) -> DataFrame:
    """Labels findings where nobody has looked at them, by exact formats, which no feature holds.

    1: key formats of providers, and keys of 18 or 40 hex digits. 0: addresses, card and phone numbers, dates, links, and
    words of the form letters-digits. Others stay without a label, and the forest judges them by likeness.
    """
    key = F.col("value").rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|[0-9a-f]{18}|[0-9a-f]{40})$")
    plain = F.col("value").rlike(r"(?i)^([\w.+-]+@[\w-]+(\.[\w-]+)+|\+?[0-9][0-9().-]+|(www\.|//|https?).*|[a-z]{3,}[0-9]{1,4}|[a-z_]+([./\\-][a-z_]+)+[0-9]{0,4}(\.[a-z]{1,4})?)$")
    return found.withColumn("label", F.when(F.length("value") <= FORMAT, F.when(key, 1.0).when(plain, 0.0)).otherwise(F.when(F.col("link"), 0.0)))


def train(labelled: DataFrame, scratch: Scratch, most: int = TRAIN, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Column:
    """Probability of a secret as a column over FEATURES, from findings with a label (0 or 1; null labels are skipped).

    Of each label the ``most`` distinct findings with the smallest hashes are learned from, so neither many copies of a
    finding nor a rare label is lost to the bound.

    The fitted trees become nested IF expressions, so scoring is plain column arithmetic. With one label only, the
    probability is that label; without any, 0.
    """
    rows = labelled.where("label is not null").select("label", F.array(*FEATURES).alias("features"), F.xxhash64("value", *FEATURES).alias("h")).distinct()
    each = [rows.where(F.col("label") == x).orderBy("h", "features").limit(most) for x in (0.0, 1.0)]
    rows = scratch.write(each[0].unionByName(each[1]), "train").select("label", array_to_vector("features").alias("features"))
    labels = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return F.lit(labels[0] if labels else 0.0)
    model = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)

    def branch(node) -> str:
        if node.subtreeDepth() == 0:
            votes = list(node.impurityStats().stats())
            return f"{votes[1] / sum(votes)!r}D"
        return f"IF({FEATURES[node.split().featureIndex()]} <= {node.split().threshold()!r}D, {branch(node.leftChild())}, {branch(node.rightChild())})"

    return F.expr(f"({' + '.join(branch(t._java_obj.rootNode()) for t in model.trees)}) / {len(model.trees)}D")


def scan(docs: DataFrame, scratch: Scratch, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each candidate of ``docs`` (doc_id, text): doc_id, at, value, probability, is_secret (from 0.5).

    ``at`` is the word number. ``labelled`` holds findings with FEATURES, value, before, after and label; without it the
    findings themselves are labelled by format, and the forest learns from at most TRAIN of each label.

    Null and empty texts: no rows. Null doc_id: kept as null. Repeated rows: findings of each.
    An empty table gives no rows. Other columns are not read. Texts of any length are searched as a whole; findings of
    one text need no common task.
    """
    docs = docs.select("doc_id", "text")
    found = scratch.write(with_features(findings(docs), docs, scratch), "findings")
    probability = train(label_by_format(found) if labelled is None else labelled, scratch)
    return found.select("doc_id", "at", "value", *FEATURES, probability.alias("probability")).withColumn("is_secret", F.col("probability") >= 0.5)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op1"))
    return out.select("doc_id", F.col("at").alias("word_no"), F.md5("value").alias("value_md5"), "probability", "is_secret")
