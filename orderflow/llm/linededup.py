"""Line dedup: SimHash of normalised lines, joined on pigeonhole blocks, verified by edit similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Lines link if their edit distance is at most (1 - SIMILAR) of the longer line's characters.
SIMILAR = 0.8
#: A line's words are dealt into classes of WORDS words or so; the first BLOCKS classes give a block of BITS bits each.
BLOCKS, BITS, WORDS = 7, 32, 3
#: Only words of so many letters vote: shorter ones are most of any text, and tell no two lines apart.
VOTING = 4
#: Lines of fewer words, or of longer ones on average, are read as runs of three letters, GRAMS or so to a class.
FEW, LONG_WORD, GRAMS = 8, 20, 2
#: Lines of so many more words, of words nearly as long, or with few words that vote are read in both ways.
EDGE, LONG_EDGE, FEW_VOTES = 3, 15, 4
#: A block counts if its words have so many letters together (a word counts 8 at most; runs: 8), or if it is the whole line.
LETTERS, GRAM_LETTERS = 12, 12
#: Of the sketch bits of the blocks beside the shared one, SimHashes of lines that link differ in this share at most, and MORE.
DIFFER, MORE = 0.25, 3
#: Of lines with more words, each word votes once.
OFTEN = 4_096
#: Up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Up to so many texts with the lines that are asked of them are broadcast.
BROADCAST_TEXTS = 250_000
#: So many code points lie below the first that stands for no letter of its own.
SINGLE_LETTERS = 0xD800
#: Words to a piece, where long lines are compared by pieces.
PIECE = 32
#: Bounds from above are tried for pairs that share so many tenths of their words.
ALIKE = 7
#: Lines of a key that more than CROWDED lines share are first paired within crowds of about CROWD, in so many rounds at most.
CROWDED, CROWD, ROUNDS = 128, 16, 2
#: A round of fewer pairs is left to the last step, which forms them too.
FEW_PAIRS = 1_000
#: A round of which one pair in so many or fewer links is the last one.
FEW_LINKS = 50
#: Votes on two bits are added at once, in lanes of 16 bits.
LANES = 0x0001_0001
#: Signs that stand at words' ends in lines that are no normal form yet.
SIGNS = """.,;:!?|*#%&$=+~<>/()[]{}"'_-"""
#: All that is no letter, mark or digit; a run of it is one space in the normal form.
NO_WORD = r"[^\p{L}\p{M}\p{N}]++"


def normal(line: Column) -> Column:
    """The form in which lines are compared: runs of signs and spaces are one space."""
    return F.trim(F.regexp_replace(line, NO_WORD, " "))


def split_lines(text: Column) -> Column:
    return F.split(F.lower(text), "\n")


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each line with a letter or digit: doc_id, text_key, line_no, node, check, down, long, keys, k, sketch.

    node and check are two hashes of the lower-cased, trimmed line; all else is read from its normal form. The SimHash of a line has a block for each class of
    its words: a word votes on the BITS bits of its own class alone, and the majority wins. There are 2^k classes, so
    that each holds some WORDS words. A changed word thus touches two blocks at most and leaves the others as they are,
    and by the pigeonhole principle lines that differ in a few words agree in whole blocks. Each of the first BLOCKS
    classes gives a key, of its bits, its number of words and their letters. A line just above the number of words where
    k changes gives those of the smaller k as well, and so does each that is read as runs, as many of their blocks are short of
    letters; one near an edge between the two ways to read a line gives those of the
    other way (down = 1), so that a word put in or left out there does not part two lines. ``sketch`` holds the first 16 bits of each block,
    long the length of the line's normal form.

    All of it happens within the line's row: no word leaves it, and nothing is added up over rows, so that a document that
    stands in the table twice has the keys that it has once.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    lines = lines.select("doc_id", "text_key", "line_no", F.trim("line").alias("line"))
    lines = lines.withColumn("norm", normal(F.col("line"))).withColumns({"words": F.split("norm", " "), "long": F.length("norm")})
    bare = F.replace("norm", F.lit(" "), F.lit(""))
    grams = F.when(F.length(bare) < 3, F.array(bare)).otherwise(F.regexp_extract_all(bare, F.lit("(?s)(?=(...))"), F.lit(1)))
    runs = (F.size("words") < FEW) | (F.col("long") > (LONG_WORD + 1) * F.size("words"))
    edge = (F.size("words") < FEW + EDGE) | (F.col("long") > (LONG_EDGE + 1) * F.size("words")) | (F.size(F.filter("words", lambda w: F.length(w) >= VOTING)) < FEW_VOTES)
    forms = F.when(runs, F.array(F.lit(True))).when(edge, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    lines = lines.select("*", F.posexplode(forms).alias("other", "runs"))
    runs, long = F.col("runs"), lambda v: F.lit(v).cast("long")
    lines = lines.select("doc_id", "text_key", "line_no", "other", F.xxhash64("line").alias("node"), F.xxhash64("line", F.lit(1)).alias("check"), "long", "runs", F.when(runs, grams).when(F.size("words") > OFTEN, F.array_distinct("words")).otherwise(F.col("words")).alias("words"))
    # a vote: the word's hash, with its letters (8 at most) in place of bits 32 to 39; 0 where the word has none
    vote = lambda w: F.when(F.length(w) >= F.when(runs, 1).otherwise(VOTING), F.xxhash64(w).bitwiseAND(long(~(255 << 32))).bitwiseOR(F.shiftleft(F.least(F.length(w), F.lit(8)).cast("long"), 32))).otherwise(long(0))
    lines = lines.withColumns({"votes": F.transform("words", vote), "k": F.length(F.bin(F.floor(F.size("words") / F.when(runs, GRAMS).otherwise(WORDS)))) - 1})
    level = lambda less: F.struct((F.col("k") - less).alias("k"), F.greatest(F.lit(less), "other").alias("down"), F.expr(f"shiftleft(1L, k - {less}) - 1").alias("mask"))
    both = (F.col("k") > 0) & (runs | (10 * F.size("votes") < 11 * WORDS * F.expr("shiftleft(1, k)")))
    # exploded, so that the number of classes is known before votes are dealt, and not worked out for each of them
    lines = lines.select("doc_id", "text_key", "line_no", "node", "check", "long", "runs", "votes", F.explode(F.when(both, F.array(level(0), level(1))).otherwise(F.array(level(0)))).alias("level"))
    place = lambda v: F.shiftrightunsigned(v, 40).bitwiseAND(F.col("level.mask"))
    of_class = lambda j: F.filter("votes", lambda v: place(v) == j)
    lines = lines.withColumn("votes", F.filter("votes", lambda v: (v != 0) & (place(v) < BLOCKS)))
    lines = lines.withColumns({f"c{j}": of_class(j) for j in range(BLOCKS)})
    sizes = lambda j: F.aggregate(f"c{j}", long(0), lambda s, v: s + F.shiftrightunsigned(v, 32).bitwiseAND(long(255)))
    lines = lines.withColumns({f"l{j}": sizes(j) for j in range(BLOCKS)} | {f"m{j}": majority(F.col(f"c{j}")) for j in range(BLOCKS)})
    keys = []
    for j in range(BLOCKS):
        n, letters = F.size(f"c{j}"), F.col(f"l{j}")
        sound = (n > 0) & ((letters >= F.when(runs, GRAM_LETTERS).otherwise(LETTERS)) | (F.col("level.k") == 0))
        keys.append(F.when(sound, F.xxhash64(f"m{j}", n, letters, "level.k", F.lit(j), "runs")))
    half = lambda j: F.shiftleft(F.col(f"m{j}").bitwiseAND(long(0xFFFF)), 16 * (j % 4))
    sketch = [reduce(Column.bitwiseOR, map(half, part)) for part in (range(4), range(4, BLOCKS))]
    return lines.select("doc_id", "text_key", "line_no", "node", "check", "level.down", "long", F.array_compact(F.array(*keys)).alias("keys"), "level.k", F.array(*sketch).alias("sketch"))


def majority(votes: Column) -> Column:
    """The BITS lowest bits, each as more than half of the votes have it."""
    n, (a, b, c, d) = F.size(votes), (F.get(votes, F.lit(i)) for i in range(4))
    both, either = Column.bitwiseAND, Column.bitwiseOR
    few = F.when(n == 0, F.lit(0).cast("long")).when(n == 1, a).when(n == 2, both(a, b)).when(n == 3, either(both(a, b), both(c, either(a, b))))
    few = few.when(n == 4, either(both(both(a, b), either(c, d)), both(both(c, d), either(a, b))))
    ones, zero = F.lit(LANES).cast("long"), F.lit(0).cast("long")
    room = (F.lit(0x7FFF) - F.shiftright(n, 1)) * ones  # carries into bit 15 of lanes with more than half

    def two_bits(known: Column, q: Column) -> Column:
        shifted = lambda v, i: F.call_function("shiftrightunsigned", v, i)
        more = F.shiftrightunsigned(F.aggregate(votes, room, lambda s, v: s + both(shifted(v, q), ones)), 15)
        return either(known, F.call_function("shiftleft", both(more, ones), q))

    return both(few.otherwise(F.aggregate(F.array(*map(F.lit, range(16))), zero, two_bits)), F.lit((1 << BITS) - 1).cast("long"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def similar(a: Column, b: Column) -> Column:
    """Whether the edit distance is small enough.

    Words that both begin or end with are left out, which does not change it. Bounds from above that are far cheaper
    than the distance between long texts are tried first: words compared place by place; the sum over pieces; the
    distance in words, each of which costs its letters and a space at most. Only where none is small enough are all letters compared.
    """
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    allowed = F.floor((1 - SIMILAR) * longer + 1e-9).cast("int")
    distance = lambda x, y, *most: F.call_function("levenshtein", x, y, *most)
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda n, v: n + v)

    def agree(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda v, w: v.eqNullSafe(w)), False)
        return let(at, lambda n: F.when(n == 0, F.least(F.size(x), F.size(y))).otherwise(n - 1).cast("int"))

    def middle(w: Column, head: Column, tail: Column) -> Column:
        return F.slice(w, head + 1, F.size(w) - head - tail)

    def by_words(x: Column, y: Column) -> Column:
        """A bound from above: each different word is one letter, so that their distance counts words."""
        words = F.array_distinct(F.concat(x, y))
        sizes = F.sort_array(F.transform(F.concat(x, y), F.length), asc=False)

        def bound(known: Column) -> Column:
            letters = lambda w: F.decode(F.unhex(F.array_join(F.transform(w, lambda v: F.lpad(F.hex(F.array_position(known, v)), 4, "0")), "")), "UTF-16BE")
            return F.when(F.size(known) >= SINGLE_LETTERS, False).otherwise(let(distance(letters(x), letters(y)), lambda n: n + total(F.slice(sizes, 1, n)) <= allowed))

        return let(words, bound)

    def whole(w: Column) -> Column:
        return F.concat(F.array_join(w, " "), F.when(F.size(w) > 0, " ").otherwise(""))

    def in_pieces(x: Column, y: Column) -> Column:
        """A bound from above: both are cut into as many pieces, which are compared one by one."""
        n = F.ceil(F.size(x) / PIECE)
        cut = lambda w, i: F.floor(i * F.size(w) / n).cast("int")
        piece = lambda w, i: whole(F.slice(w, cut(w, i) + 1, cut(w, i + 1) - cut(w, i)))
        return total(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: distance(piece(x, i), piece(y, i)))) <= allowed

    def within(s: Column) -> Column:
        x, y = s["x"], s["y"]
        in_place = F.when(F.size(x) == F.size(y), total(F.zip_with(x, y, lambda v, w: distance(v, w))) <= allowed).otherwise(False)
        cheap = in_place | ((F.size(x) > PIECE) & (F.size(y) > PIECE) & in_pieces(x, y)) | ((F.size(x) > 1) & (F.size(y) > 1) & by_words(x, y))
        # the bounds are for pairs that probably link: others, and short ones, are compared at once
        fewer = F.least(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
        alike = (F.least(F.size(x), F.size(y)) > PIECE) & (10 * F.size(F.array_intersect(x, y)) >= ALIKE * fewer)
        return F.when(alike, cheap).otherwise(False) | (distance(whole(x), whole(y), allowed) >= 0)

    def trimmed(s: Column) -> Column:
        x, y = s["x"], s["y"]
        ends = lambda head: let(F.least(agree(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - head), lambda tail: let(F.struct(middle(x, head, tail).alias("x"), middle(y, head, tail).alias("y")), within))
        return let(agree(x, y), ends)

    pair = F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    return F.when(longer - shorter > allowed, False).otherwise(let(pair, trimmed))


def near(x: Column, y: Column, k: Column) -> Column:
    """Whether two lines (long, sketch) that share a block may link, by their lengths and the sketches of the other blocks."""
    others = F.least(F.lit(BLOCKS), F.call_function("shiftleft", F.lit(1), k)) - 1
    differ = sum(F.bit_count(F.get(x["sketch"], F.lit(i)).bitwiseXOR(F.get(y["sketch"], F.lit(i)))) for i in range(2))
    longer, shorter = F.greatest(x["long"], y["long"]), F.least(x["long"], y["long"])
    return (longer - shorter <= F.floor((1 - SIMILAR) * longer + 1e-9)) & (differ <= F.floor(others * (16 * DIFFER)) + MORE)


def linked_lines(spots: DataFrame, verify: Callable[[DataFrame, Scratch], DataFrame], scratch: Scratch) -> DataFrame:
    """(node, root) of all lines that share a key and link, without forming all pairs of a key's lines.

    Each line is first paired with one line of its key, the one with the least hash, and what links is contracted. Lines
    of keys that many share are then dealt into crowds by a hash, another one in each round, and paired within them as far
    as they are in different groups; what links is contracted before the next round. A dense group thus ends as one
    after a few pairs for each of its lines. Last, all lines that share a key and are still in different groups are paired,
    but for pairs that were. A pair that is never formed joins lines that are connected already, so the groups are
    those of all links. Sketches travel with the keys, and only pairs with near ones are verified.
    """
    room, one = Scratch(scratch.spark, "links"), F.struct("node", "long", "sketch")
    posts = spots.select(one.alias("one"), "k", F.explode("keys").alias("key"))
    # the keys alone go to the driver and all tasks, not the lines that stand first under them
    ends = posts.groupBy("key").agg(F.min("one.node").alias("lo"), F.max("one.node").alias("hi"))
    several = room.write(ends.where("lo < hi").select("key"), "several")
    wanted = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    shared = room.write(posts.join(wanted, "key", "left_semi").select("key", "k", "one").distinct(), "shared")
    star = shared.join(shared.groupBy("key").agg(F.min("one").alias("first")), "key").where((F.col("one.node") != F.col("first.node")) & near(F.col("one"), F.col("first"), F.col("k")))
    tried = room.write(star.select(F.col("first.node").alias("a"), F.col("one.node").alias("b")).distinct(), "star")
    links = room.write(verify(tried, room), "star-links")
    roots = components(links, room)

    def across(rows: DataFrame, *by: str) -> DataFrame:
        """(a, b): near lines of different groups that agree in ``by``, but for pairs that were tried."""
        left, right = rows.select(*by, "k", F.col("one").alias("a"), F.col("root").alias("a_root")), rows.select(*by, F.col("one").alias("b"), F.col("root").alias("b_root"))
        pairs = left.join(right, [*by]).where((F.col("a.node") < F.col("b.node")) & (F.col("a_root") != F.col("b_root")) & near(F.col("a"), F.col("b"), F.col("k")))
        return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")

    few = False
    for turn in range(ROUNDS + 1):
        rooted = shared.withColumn("node", F.col("one.node")).join(roots, "node", "left").select("key", "k", "one", F.coalesce("root", "node").alias("root"))
        rooted = room.write(rooted, "rooted")
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
        mixed = room.write(rooted.join(several, "key"), "mixed")
        crowded = mixed.where(F.col("n") > CROWDED)
        if turn == ROUNDS or few or crowded.isEmpty():
            break
        crowd = F.pmod(F.xxhash64("one.node", "key", F.lit(turn)), F.ceil(F.col("n") / CROWD))
        pairs = room.write(across(crowded.withColumn("crowd", crowd), "key", "crowd"), "crowds")
        if pairs.count() < FEW_PAIRS:
            break
        found = room.write(verify(pairs, room), "links")
        tried = tried.unionByName(pairs)
        few = pairs.count() >= FEW_LINKS * found.count()
        links = links.unionByName(found)
        roots = components(links, room)
    rest = room.write(verify(room.write(across(mixed, "key"), "across"), room), "links")
    roots = scratch.write(roots if rest.isEmpty() else components(links.unionByName(rest), room), "roots")
    room.drop()
    return roots


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, dropped: the line numbers of a document that repeat an earlier line of the corpus."""
    held = scratch.write(signatures(docs), "signatures")
    spots = held.where("down = 0")
    place = F.struct("doc_id", "text_key", "line_no")

    def verify(pairs: DataFrame, room: Scratch) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        firsts = spots.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_key", "line_no")).alias("at"))
        firsts = room.write(firsts.groupBy("at.text_key").agg(F.collect_list(F.struct("at.line_no", "node")).alias("wanted")), "firsts")
        wanted = F.broadcast(firsts) if firsts.count() <= BROADCAST_TEXTS else firsts
        found = docs.select("text", F.xxhash64("text").alias("text_key")).join(wanted, "text_key")
        lines = found.select(split_lines(F.col("text")).alias("lines"), "wanted")
        found = lines.select(F.inline(F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), F.get("lines", w["line_no"]).alias("line")))))
        texts = found.dropDuplicates(["node"]).select("node", normal(F.col("line")).alias("norm"))
        texts = room.write(texts, "texts")
        for end in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("norm").alias(f"{end}_norm")), end)
        return pairs.where(similar(F.col("a_norm"), F.col("b_norm"))).select("a", "b")

    roots = linked_lines(held, verify, scratch)
    # copies of a line are told by 128 bits; lines that link to others by the 64 bits of their group
    placed = spots.join(roots, "node", "left").select(F.coalesce("root", "node").alias("g"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("c"), place.alias("at"))
    placed = scratch.write(placed, "placed")
    firsts = placed.groupBy("g", "c").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = placed.join(firsts, ["g", "c"]).where(~F.col("at").eqNullSafe(F.col("first")))
    return again.groupBy("at.doc_id", "at.text_key").agg(F.collect_set("at.line_no").alias("dropped"))


def dedup_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), all columns, with repeated lines taken out of text, and n_lines, n_dropped.

    Lines end at LF. Two lines link if they are equal once lower-cased and trimmed, or if they share a block of their
    SimHashes (``signatures``), these are ``near``, and their normal forms have an edit similarity of 0.8 or more. In its normal form a line
    is lower-cased, and runs of signs and spaces are one space. Of each connected group the first occurrence stays, by
    doc_id (null first), a hash of the text, line number.

    Null text stays null: 0 lines. Lines without letters and digits always stay. Null doc_id: such rows come first.
    Rows that repeat both id and text are one document: a line that stays does so in each of them. An empty table gives
    no rows. Columns named n_lines or n_dropped in ``docs`` are replaced. Lines of any length are compared as a whole.
    """
    docs = docs.drop("n_lines", "n_dropped")
    dropped = scratch.write(repeated_lines(docs.select("doc_id", "text"), scratch), "dropped")
    size = dropped.agg(F.count(F.lit(1)), F.sum(F.size("dropped"))).first()
    dropped = F.broadcast(dropped) if (size[1] or 0) <= 2 * BROADCAST_ROWS else dropped
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}  # other columns may have any name
    text = F.col(names["text"])
    same = F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key"))
    out = docs.toDF(*names.values()).join(dropped, same, "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("dropped", i)), "\n")
    kept = F.when(F.col("dropped").isNull(), text).otherwise(kept)
    counts = (F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"))
    return out.select(*(kept.alias(c) if c == "text" else F.col(n).alias(c) for c, n in names.items()), *counts)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op10"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))
