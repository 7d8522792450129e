"""Operator 5: near-duplicate lines by a segment-partition edit join. DataFrame operations only.

A line goes if an equal line, or one within EDITS edits (of characters: insert, delete, substitute), stands before it in the corpus, in the order of doc_id
and place in the document. Lines of fewer than SHORTEST characters go only if an equal one stands before. Blank lines stay. Nearness is
as found between the lines of the input: a line also goes if the line before it that it is near to goes itself.

A pair within t edits shares one of t+1 segments of the shorter line, at a place that the lengths bound: so each line is filed by its own
t+1 segments, and probes, for each length down to t less, the substrings that can stand for a segment (multi-match-aware). Keys with one
line only are dropped before lines meet; of lines that meet, counts of character classes (at most two change by an edit) are compared first;
then the banded bit-parallel edit distance: for each number of errors a bit for each of the 2t+1 diagonals, updated by a character at a time.

Equal lines count once, by partial minima. Lines meet by key only, and hot keys can be split by the adaptive skew join.

Null text: stays null, no lines. Rows with a null doc_id stay as they are. doc_ids identify documents: rows of one id are as one document. Extra columns are kept (but for
_lines, _equal and _near, which the result has itself). Very long lines are filed like others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import maybe_in, packed, quoted, shared_folder, unpacked, written

EDITS, SHORTEST = 2, 20
#: Disjoint classes of characters, whose counts bound the edit distance from below.
CLASSES = ("eE", "tT", "aA", "oO", "nN", "iI", "hH", "sS", "rR", "dD", "lL", "uU", "gG", "bB", "wW", "fF", "cC", "pP", "mM", "vV", "yY", "kK", " ", ",", ".", "éÉèÈêÊ", "äÄöÖüÜß", "áíóúñ", "0123", "456789")


def places(t: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift of its place): the line's own segments first, then its probes."""
    out = [(0, i, 0) for i in range(t + 1)]
    for shorter in range(t + 1):
        for i in range(t + 1):
            low, high = max(-i, shorter - (t - i)), min(i, shorter + (t - i))
            out += [(shorter, i, shift) for shift in range(low, high + 1) if (shorter, shift) != (0, 0)]
    return out


def filed_lines(lines: DataFrame, t: int) -> DataFrame:
    """lines (line, size, ...): a row for each of places(t) that fits, with key (of length, number and text of a segment) and own.

    The places are exploded before the key is computed: one small expression, which the JVM compiles, instead of one for each place.
    """
    at = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit((d, s) == (0, 0)).alias("own")) for d, i, s in places(t)))
    p = lines.withColumn("p", F.explode(at)).filter(F.col("size") - F.col("p.d") >= SHORTEST)  # then every place is inside the line
    p = p.withColumns({"_n": F.col("size") - F.col("p.d"), "_from": F.expr(f"cast(((size - p.d) * p.i) div {t + 1} as int)"), "_to": F.expr(f"cast(((size - p.d) * (p.i + 1)) div {t + 1} as int)")})
    key = F.xxhash64("_n", "p.i", F.substring(F.col("line"), F.col("_from") + F.col("p.s") + 1, F.col("_to") - F.col("_from")))
    return p.select(*lines.columns, key.alias("key"), F.col("p.own").alias("own"))


def within(a: Column, b: Column, t: int) -> Column:
    """Whether the edit distance of two strings is at most t: bit k of level e after j characters of b says that i = j - t + k characters of a are e edits away at most."""
    m, n = F.length(a), F.length(b)
    wide = (1 << 2 * t + 1) - 1
    one = lambda v: F.lit(v).cast("long")
    names = [f"e{e}" for e in range(t + 1)]
    levels = [one(sum(1 << t + i for i in range(e + 1)) & wide).alias(names[e]) for e in range(t + 1)]
    # the state holds the characters of a, so that they are split once
    start = F.struct(F.split(a, "").alias("x"), F.lit(0).alias("j"), F.struct(*levels).alias("e"), one(0).alias("same"))

    def match(s: Column, c: Column) -> Column:
        """Bit k: whether character j - t + k of a is the j-th of b."""
        same = one(0)
        for k in range(2 * t + 1):
            same = same.bitwiseOR(F.when(F.get(s["x"], s["j"] - t + k) == c, one(1 << k)).otherwise(one(0)))
        return same

    def step(s: Column, same: Column) -> Column:
        new: list[Column] = []
        for e in range(t + 1):
            v = s[names[e]].bitwiseAND(same)
            if e:
                before = s[names[e - 1]]
                v = v.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(one(wide))
            new.append(v)
        return F.struct(*(v.alias(k) for v, k in zip(new, names, strict=True)))

    def advance(s: Column, c: Column) -> Column:
        # the levels follow one character later, when their mask is in the state and need not be computed for each of them
        e = F.when(s["j"] > 0, step(s["e"], s["same"])).otherwise(s["e"])
        return F.struct(s["x"].alias("x"), (s["j"] + 1).alias("j"), e.alias("e"), match(s, c).alias("same"))

    end = F.aggregate(F.split(b, ""), start, advance, lambda s: step(s["e"], s["same"])[names[t]])
    last = F.when(n > 0, end).otherwise(one(sum(1 << t + i for i in range(t + 1)) & wide))
    at = m - n + t
    return (at >= 0) & (at <= 2 * t) & (F.call_function("getbit", last, at.cast("int")) == 1)


def _equal_blocks(a: Column, b: Column, size: Column, most: Column, behind: bool) -> Column:
    """How many blocks of `size` characters are equal from the front (behind: from the end) on, of `most`."""
    def same(i: Column) -> Column:
        p = (lambda s: F.substring(s, (F.length(s) - (i + 1) * size + 1).cast("int"), size)) if behind else (lambda s: F.substring(s, (i * size + 1).cast("int"), size))
        return p(a) == p(b)

    return F.when(most > 0, F.coalesce(F.nullif(F.array_position(F.transform(F.sequence(F.lit(0), (most - 1).cast("int")), same), False), F.lit(0)) - 1, most)).otherwise(F.lit(0))


def trimmed(pairs: DataFrame, a: str, b: str, blocks: int = 64) -> DataFrame:
    """The pairs without most of what both lines begin and end with, which leaves their distance as it is."""
    size = F.greatest(F.lit(8), (F.least(F.length(a), F.length(b)) / blocks).cast("int"))
    p = pairs.withColumn("_size", size)
    p = p.withColumn("_front", _equal_blocks(F.col(a), F.col(b), F.col("_size"), F.floor(F.least(F.length(a), F.length(b)) / F.col("_size")), False) * F.col("_size"))
    for c in (a, b):
        p = p.withColumn(c, F.substring(F.col(c), (F.col("_front") + 1).cast("int"), F.length(c)))
    p = p.withColumn("_end", _equal_blocks(F.col(a), F.col(b), F.col("_size"), F.floor(F.least(F.length(a), F.length(b)) / F.col("_size")), True) * F.col("_size"))
    for c in (a, b):
        p = p.withColumn(c, F.substring(F.col(c), F.lit(1), (F.length(c) - F.col("_end")).cast("int")))
    return p.drop("_size", "_front", "_end")


def _profile(line: Column) -> Column:
    n = F.length(line)
    return F.array(*((n - F.length(F.translate(line, c, ""))).cast("int") for c in CLASSES), n)


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, pos, line, and two hashes of each line that isn't blank."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.col("line").rlike(r"\S"))
    return lines.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64("line", F.lit(1))})


def near_lines(lines: DataFrame, folder: str, t: int = EDITS) -> DataFrame:
    """Pairs (h_a, g_a, h_b, g_b) of hashes of different lines within t edits; both orders."""
    lines = lines.select("line", "h", "g", F.length("line").alias("size")).filter(F.col("size") >= SHORTEST)
    filed = filed_lines(lines, t)
    keys = filed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max(F.col("own").cast("int")).alias("own")).filter("low <> high and own = 1").select("key")
    keys = written(keys, folder, "keys")
    some = maybe_in(filed.select("key", "own", "h", "g"), "key", keys).filter("_maybe").drop("_maybe").distinct().join(keys, "key")
    some = written(some, folder, "filed")
    needed = maybe_in(lines, "h", some).filter("_maybe").groupBy("h", "g").agg(F.min("line").alias("line"))  # equal lines become one before they meet anything
    texts = written(needed.join(some.select("h", "g").distinct(), ["h", "g"], "left_semi"), folder, "texts")
    some = some.join(written(texts.select("h", "g", _profile(F.col("line")).alias("profile")), folder, "profiles"), ["h", "g"])
    x, y = some.filter("own").alias("x"), some.alias("y")
    differ = F.aggregate(F.zip_with("x.profile", "y.profile", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
    size = len(CLASSES)  # the last of the profile is the length: an edit changes two classes and the length by one each at most
    apart = F.abs(F.col("x.profile")[size] - F.col("y.profile")[size])
    meet = (F.col("x.key") == F.col("y.key")) & ((F.col("x.h") != F.col("y.h")) | (F.col("x.g") != F.col("y.g"))) & (apart <= t) & (differ - apart <= 2 * t)
    pairs = x.join(y, meet).select(F.struct("x.h", "x.g").alias("x"), F.struct("y.h", "y.g").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = written(pairs.select(F.col("x.h").alias("h_a"), F.col("x.g").alias("g_a"), F.col("y.h").alias("h_b"), F.col("y.g").alias("g_b")), folder, "pairs")
    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("h").alias(f"h_{c}"), F.col("g").alias(f"g_{c}"), F.col("line").alias(f"line_{c}")), [f"h_{c}", f"g_{c}"])
    pairs = written(trimmed(pairs.repartition("h_a", "h_b"), "line_a", "line_b"), folder, "trimmed")
    near = pairs.filter(within(F.col("line_a"), F.col("line_b"), t)).select("h_a", "g_a", "h_b", "g_b")
    return near.union(near.select("h_b", "g_b", "h_a", "g_a"))


def dropped_lines(docs: DataFrame, folder: str, t: int = EDITS) -> DataFrame:
    """docs (doc_id, text): doc_id, equal and near (arrays of places of lines that go, from 0) of documents with such lines."""
    near = written(near_lines(lines_of(docs), folder, t), folder, "near")
    lines = written(lines_of(docs).select("doc_id", "pos", "h", "g"), folder, "lines")  # without their texts
    first = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("times"))
    ends = near.select(F.col("h_a").alias("h"), F.col("g_a").alias("g")).distinct().withColumn("paired", F.lit(True))
    first = first.join(ends, ["h", "g"], "left").filter("times > 1 or paired")
    first = written(first, folder, "first")
    one = near.join(first.select(F.col("h").alias("h_a"), F.col("g").alias("g_a"), F.col("first").alias("mine")), ["h_a", "g_a"]).join(first.select(F.col("h").alias("h_b"), F.col("g").alias("g_b"), F.col("first").alias("its")), ["h_b", "g_b"])
    late = one.filter("its < mine").select(F.col("h_a").alias("h"), F.col("g_a").alias("g")).distinct().withColumn("late", F.lit(True))
    first = written(first.join(late, ["h", "g"], "left").filter("times > 1 or late").select("h", "g", "first", "late"), folder, "judged")
    some = maybe_in(lines, "h", first).filter("_maybe").join(first, ["h", "g"])
    again = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.pos") != F.col("pos"))
    gone = some.filter(again | F.coalesce("late", F.lit(False))).select("doc_id", "pos", again.alias("equal")).distinct()
    places = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("pos"))))
    return written(gone.groupBy("doc_id").agg(places(F.col("equal")).alias("equal"), places(~F.col("equal")).alias("near")), folder, "gone")


def without_repeated_lines(docs: DataFrame, t: int = EDITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the lines left as text, and _lines, _equal, _near: how many lines that aren't blank there were, and went."""
    folder = shared_folder(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("_lines", "_equal", "_near")]
    rows = packed(docs, doc_id=F.col(quoted(doc_id)), text=F.col(quoted(text)))
    gone = dropped_lines(rows.select("doc_id", "text"), folder, t)
    rows = maybe_in(rows, "doc_id", gone)
    all_ = F.split("text", "\n", -1)
    count = F.coalesce(F.size(F.filter(all_, lambda x: x.rlike(r"\S"))), F.lit(0)).alias("_lines")
    same = rows.filter("not _maybe").select(*unpacked(columns), count, F.lit(0).alias("_equal"), F.lit(0).alias("_near"))
    some = rows.filter("_maybe").join(gone.hint("shuffle_hash"), "doc_id", "left")  # places are hashed, so that no texts are sorted
    none = F.array().cast("array<int>")
    out = F.array_union(F.coalesce("equal", none), F.coalesce("near", none))
    left = F.when(F.size(out) > 0, F.array_join(F.filter(all_, lambda _, i: ~F.array_contains(out, i)), "\n")).otherwise(F.col("text"))
    some = some.select(*unpacked(columns, **{text: left}), count, F.coalesce(F.size("equal"), F.lit(0)).alias("_equal"), F.coalesce(F.size("near"), F.lit(0)).alias("_near"))
    return same.unionByName(some)
