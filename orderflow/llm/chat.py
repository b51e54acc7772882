"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks, then turns are rendered.

A line is seen as a speaker marker and some features (see ``observe``). Hidden states are a role and whether the line
begins a turn. Lines are range-sorted by transcript; each range is decoded by itself, and transcripts that run over
the edge of a range are joined exactly: a range tells, for every state before it, the best score of every state at its
end (a max-plus matrix), the few matrices of a transcript are chained, and the range is decoded between fixed ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

ROLES = ("system", "user", "assistant")
#: State 2 * role + 0 begins a turn of the role, + 1 goes on with it.
STATES = 2 * len(ROLES)
MARKERS = {
    "system": r"^\s*[\[<#*]*\s*(?i:system|note|context)\b\s*[\]>*]*\s*(?::|\]|>)\s*",
    "user": r"^\s*[\[<#*]*\s*(?i:user|human|customer|question|instruction|q)\b\s*[\]>*]*\s*(?::|\]|>)\s*",
    "assistant": r"^\s*[\[<#*]*\s*(?i:assistant|ai|bot|answer|response|a)\b\s*[\]>*]*\s*(?::|\]|>)\s*",
}
#: Numbers of values of the features: marker, length, end, blank line before, first line.
KINDS = (4, 6, 4, 2, 2)
FEATURES = ("marker", "long", "ending", "gap", "first")


@dataclass
class Model:
    """Log probabilities: of states at the start, of a state after another, of each feature's values by state."""

    start: np.ndarray
    step: np.ndarray
    sees: list[np.ndarray]

    def emissions(self, lines: pd.DataFrame) -> np.ndarray:
        return sum(table[:, lines[f].to_numpy()].T for f, table in zip(FEATURES, self.sees))


def observe(line: Column) -> list[Column]:
    """The features of a line but gap and first, as small integers."""
    marker = F.when(line.rlike(MARKERS["system"]), 1).when(line.rlike(MARKERS["user"]), 2).when(line.rlike(MARKERS["assistant"]), 3).otherwise(0)
    n = F.length(line)
    long = F.when(n == 0, 0).when(n < 40, 1).when(n < 100, 2).when(n < 200, 3).when(n < 400, 4).otherwise(5)
    last = F.substring(F.rtrim(line), -1, 1)
    ending = F.when(last == "?", 1).when(last == ".", 2).when(last == "", 3).otherwise(0)
    return [F.coalesce(c, F.lit(0)).cast("int").alias(f) for c, f in zip((marker, long, ending), FEATURES)]


def unmarked(line: Column, role: Column) -> Column:
    """The first line of a turn without the speaker marker of its role; other markers are text."""
    out = line
    for name in ROLES:
        out = F.when(role == name, F.regexp_replace(line, MARKERS[name], "")).otherwise(out)
    return out


def sorted_lines(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, range, n, line, blanks, features, and role and begins where ``lines`` has them.

    ``lines``: conv_id, pos (anything sortable), line. They are sorted by transcript and position; range is the number
    of a line's part of the sorted table, n its place therein. A blank line is no row of its own: blanks is the number
    of those before a line, also of those in earlier ranges.
    """
    truth = [c for c in ("role", "begins") if c in lines.columns]
    order = [F.col("conv_id").asc_nulls_first(), F.col("pos"), F.col("line")]
    ranged = lines.select("conv_id", "pos", "line", *truth).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    held = scratch.write(ranged, "ranges")
    w = W.partitionBy("range", "conv_id").orderBy("pos", "line")
    filled = F.trim("line") != ""
    behind = w.rowsBetween(W.unboundedPreceding, -1)
    since = F.coalesce(F.row_number().over(w) - 1 - F.last(F.when(filled, F.col("_nth")), ignorenulls=True).over(behind), F.row_number().over(w) - 1)
    # blank lines at the end of a part of a transcript count before its first line in a later range
    tails = held.withColumn("_nth", F.row_number().over(w)).groupBy("range", "conv_id").agg(F.max(F.when(filled, F.col("_nth"))).alias("_last"), F.count(F.lit(1)).alias("_all"))
    earlier = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    upto = F.coalesce(F.sum("_all").over(earlier), F.lit(0))
    tails = tails.withColumn("_upto", upto).withColumn("_carried", upto - F.coalesce(F.max(F.when(F.col("_last").isNotNull(), F.col("_upto") + F.col("_last"))).over(earlier), F.lit(0)))
    tails = scratch.write(tails.select(F.col("range").alias("_range"), F.col("conv_id").alias("_id"), "_carried"), "tails")
    first = F.coalesce(F.count_if(filled).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 0
    # a transcript that begins in an earlier range does not begin here
    opening = held.where(filled).groupBy(F.col("conv_id").alias("_conv")).agg(F.min("range").alias("_from"))
    place = F.row_number().over(W.partitionBy("range").orderBy(*order))
    out = held.withColumn("_nth", F.row_number().over(w)).select("*", place.alias("n"), since.alias("blanks"), first.alias("_first"))
    out = out.join(tails, (F.col("range") == F.col("_range")) & F.col("conv_id").eqNullSafe(F.col("_id")))
    out = out.withColumn("blanks", F.when(F.col("_first"), F.col("blanks") + F.col("_carried")).otherwise(F.col("blanks")).cast("int")).withColumn("gap", (F.col("blanks") > 0).cast("int"))
    out = out.join(opening, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    out = out.withColumn("first", (F.col("_first") & (F.col("range") == F.col("_from"))).cast("int")).where("trim(line) <> ''")
    return scratch.write(out.select("conv_id", "range", "n", "line", "blanks", *truth, *observe(F.col("line")), "gap", "first"), "lines")


def train(lines: DataFrame, smooth: float = 0.5) -> Model:
    """Counts over ``sorted_lines`` with role and begins; lines of other roles are skipped."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    seen = lines.where(F.col("role").isin(*ROLES)).withColumn("state", (2 * role + F.when(F.col("begins"), 0).otherwise(1)).cast("int"))
    w = W.partitionBy("range", "conv_id").orderBy("n")  # a step over the edge of a range is not counted
    seen = seen.withColumn("after", F.lag("state").over(w))
    step, start = np.full((STATES, STATES), smooth), np.full(STATES, smooth)
    sees = [np.full((STATES, k), smooth) for k in KINDS]
    # at most STATES * (STATES + 1) * product of KINDS rows
    for r in seen.groupBy("state", "after", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect():
        if r["after"] is not None:
            step[r["after"], r["state"]] += r["n"]
        if r["first"]:
            start[r["state"]] += r["n"]
        for f, table in zip(FEATURES, sees):
            table[r["state"], r[f]] += r["n"]
    for role in range(len(ROLES)):  # a turn goes on in its own role only
        step[:, 2 * role + 1] = np.where(np.arange(STATES) // 2 == role, step[:, 2 * role + 1], 1e-9)
    start[1::2] = 1e-9
    log = lambda t: np.log(t / t.sum(axis=-1, keepdims=True))
    return Model(log(start), log(step), [log(t) for t in sees])


def viterbi(model: Model, emissions: np.ndarray, enter: int | None = None, leave: int | None = None) -> np.ndarray:
    """Best states of one run of lines; ``enter`` is the state before it, ``leave`` the last state, where given."""
    best = (model.start if enter is None else model.step[enter]) + emissions[0]
    back = np.zeros(emissions.shape, np.int8)
    for t in range(1, len(emissions)):
        way = best[:, None] + model.step
        back[t] = way.argmax(axis=0)
        best = way.max(axis=0) + emissions[t]
    states = np.zeros(len(emissions), np.int8)
    states[-1] = best.argmax() if leave is None else leave
    for t in range(len(emissions) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def reach(model: Model, emissions: np.ndarray) -> np.ndarray:
    """Row i: best score of each state at the end of a run after state i; the last row: where the run begins all."""
    best = np.vstack([model.step, model.start]) + emissions[0]
    for e in emissions[1:]:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + e
    return best


def chain(matrices: Sequence[np.ndarray]) -> list[tuple[int | None, int]]:
    """State before and at the end of each run of one transcript, in order, on its best path."""
    score, backs = matrices[0][STATES], []
    for m in matrices[1:]:
        way = score[:, None] + m[:STATES]
        backs.append(way.argmax(axis=0))
        score = way.max(axis=0)
    ends = [int(score.argmax())]
    for back in reversed(backs):
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return [(None if i == 0 else ends[i - 1], e) for i, e in enumerate(ends)]


def _runs(pdf: pd.DataFrame):
    """(first, last + 1) of each transcript in a range sorted by transcript; null ids are equal."""
    ids = pdf["conv_id"].to_numpy()
    same = (ids[1:] == ids[:-1]) | (pd.isna(ids[1:]) & pd.isna(ids[:-1]))
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(pdf)]
    return zip(cuts[:-1], cuts[1:])


def recover(lines: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """conv_id, range, n, line, blanks, state for ``sorted_lines``: the best path of each transcript as a whole."""
    known = lines.sparkSession.sparkContext.broadcast(model)
    columns = ["conv_id", "range", "n", "line", "blanks", *FEATURES]

    several = lines.groupBy("conv_id").agg(F.min("range").alias("lo"), F.max("range").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("_conv"))
    several = scratch.write(several, "several")  # at most one more than there are ranges

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n").reset_index(drop=True)
        out = [(pdf["conv_id"].iloc[a], pdf["range"].iloc[a], reach(known.value, known.value.emissions(pdf.iloc[a:b])).ravel().tolist()) for a, b in _runs(pdf)]
        return pd.DataFrame(out, columns=["conv_id", "range", "m"])

    cut = lines.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    parts = cut.select(*columns).groupBy("range").applyInPandas(matrix, "conv_id long, range int, m array<double>")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range")
        ends = chain([np.array(m).reshape(STATES + 1, STATES) for m in pdf["m"]])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "range": pdf["range"], "enter": [-1 if e is None else e for e, _ in ends], "leave": [e for _, e in ends]})

    ends = scratch.write(parts.groupBy("conv_id").applyInPandas(joined, "conv_id long, range int, enter int, leave int"), "ends")
    ends = ends.select(F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), "enter", "leave")

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n").reset_index(drop=True)
        score = known.value.emissions(pdf)
        state = np.zeros(len(pdf), np.int32)
        for a, b in _runs(pdf):
            enter, leave = pdf["enter"].iloc[a], pdf["leave"].iloc[a]
            whole = pd.isna(leave)
            state[a:b] = viterbi(known.value, score[a:b], None if whole or enter < 0 else int(enter), None if whole else int(leave))
        return pdf[["conv_id", "range", "n", "line", "blanks"]].assign(state=state)

    fixed = lines.select(*columns).join(F.broadcast(ends), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")), "left")
    return fixed.select(*columns, "enter", "leave").groupBy("range").applyInPandas(decode, "conv_id long, range int, n int, line string, blanks int, state int")


def render(states: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn_no, role, n_lines, text: turns in canonical form, ``<|im_start|>role LF text<|im_end|>``.

    A turn keeps its lines as they are, blank ones between them as well; its first line loses the marker of its role.
    """
    held = scratch.write(states.withColumn("begins", (F.col("state") % 2 == 0).cast("long")), "states")
    inside = W.partitionBy("range", "conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = held.groupBy("conv_id", "range").agg(F.sum("begins").alias("n")).select(F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("turns"))
    lines = held.withColumn("turn", F.sum("begins").over(inside)).join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")))
    lines = lines.select("conv_id", F.greatest(F.lit(1), F.col("turn") + F.col("turns")).alias("turn_no"), F.struct("range", "n").alias("at"), "line", "blanks", F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 2) + 1).cast("int")).alias("role"))
    turns = lines.groupBy("conv_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("at", "line", "role", "blanks"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.when(x["at"] == F.get("all", F.lit(0))["at"], unmarked(x["line"], x["role"])).otherwise(F.concat(F.repeat(F.lit("\n"), x["blanks"]), x["line"]))), "\n")
    role = F.get("all", F.lit(0))["role"]
    return turns.select("conv_id", "turn_no", role.alias("role"), F.size("all").alias("n_lines"), F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>")).alias("text"))


#: Ways in which the turns of a conversation are written into a raw transcript: system, user, assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("System: ", "Human: ", "AI: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("Note: ", "Q: ", "A: "),
    ("### System: ", "### Instruction: ", "### Response: "),
    ("", "", ""),
)


def raw_lines(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, line, role, begins: the lines of raw transcripts of (conv_id, turn, role, text).

    A conversation's style follows from its id. Every seventh turn and those of the last style have no marker, and a
    blank line stands before them. Roles and beginnings are kept as the truth to train on and to test against.
    """
    style = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in STYLES)), (F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % len(STYLES) + 1).cast("int"))
    spot = F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    bare = F.crc32(spot.cast("binary")) % 7 == 0
    marker = F.coalesce(F.get(style, (F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1).cast("int")), F.lit(""))
    marker = F.when(bare, "").otherwise(marker)
    raw = F.concat(F.when(marker == "", "\n").otherwise(""), marker, F.coalesce("text", F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.posexplode(F.split(raw, "\n")).alias("line_no", "line"), (marker == "").alias("bare"))
    begins = F.col("line_no") == F.when(F.col("bare"), 1).otherwise(0)
    return rows.select("conv_id", F.struct("turn", "line_no").alias("pos"), "line", "role", begins.alias("begins"))


def trained_on(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def format_conversations(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn_no, role, n_lines, text: canonical turns recovered from the raw transcripts of ``conversations``.

    The model learns from conversations whose crc32(conv_id) mod 5 is not 0; role is no input of what is recovered.

    Null text: an empty turn, of which nothing is left. Null conv_id: all such rows are one transcript, not learned
    from. Null turn: first of its transcript. Null or other roles: not learned from. Repeated rows and turns with the
    same number: their lines stand in the order of line number and text. An empty table gives no rows. Other columns are
    not read. A transcript of any length is spread over ranges, and its turns are rendered one by one.
    """
    lines = sorted_lines(raw_lines(conversations.select("conv_id", "turn", "role", "text")), scratch)
    model = train(lines.where(trained_on(F.col("conv_id"))))
    return render(recover(lines.drop("role", "begins"), model, scratch), scratch)


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    out = format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark, "op4"))
    return out.select("conv_id", "turn_no", "role", "n_lines", F.md5("text").alias("text_md5"))
