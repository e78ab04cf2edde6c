"""Line dedup by winnowing over line hashes. DataFrame functions only.

A line ends at a line feed, or at a full stop, exclamation or question mark and a space, since corpora hold whole
paragraphs in a line. A run of lines (those without words aside) of at least MIN_WORDS words is deleted wherever an equal run
stands at an earlier place, with the blank lines inside it; order is by doc_id, then by content, then by place.

Winnowing: each line with words is hashed. The windows are the runs of MIN_WORDS words that fall short of them without their
first line and without their last; the least hash in a window is its fingerprint. A run of MIN_WORDS words holds a window and
with it a fingerprint, so repeated runs share one for certain, however few or many lines they have. Fingerprints are joined
with their other places; only windows around those that have any go on.

Extension: such windows are compared as a whole, and where they match, both ways: backwards by the runs that reach MIN_WORDS
only with their first line, forwards by those that do only with their last, and pairs of lines that are windows each. Such
runs within a repeated run cover all of it, and which they are follows from the lines inside them alone; so a line is
deleted if one of them around it isn't at the first of all its places. Runs meet by two independent hashes
of 96 bits in all (of lines and then of runs), by which alone they count as equal; documents are never
compared in pairs, whatever number of them shares a passage.

Nulls and edges: a null text stays null; rows without an id come first; rows that share id and text are one document and
all get the same result; other rows that share an id count as documents of their own; lines without words stay,
but inside a deleted run. An empty table gives an empty result. `drop_repeats` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, let, starts

#: Least words of a run that is deleted.
MIN_WORDS = 25
#: Where lines end; the parts keep their ends, so that joining them gives the text.
SPLIT = "(?<=\\n)|(?<=[.!?]\\x20)"
MARK = "\x01"
#: What names a document: its id (null ids the smallest) and a hash of both.
KEY = ["d", "uid"]


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("uid")]


def _parts(text: Column) -> Column:
    """The lines of a text. Where it has no mark of its own, marks are set at line ends, which is faster than SPLIT."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, SPLIT, -1)).otherwise(F.split(marked, MARK, -1))


def _windows(n: Column) -> Column:
    """The windows' first and last lines, by place, from the lines' numbers of words."""

    def found(e: Column) -> Column:
        each = F.transform(e, lambda x, i: F.struct(i.alias("a"), x.alias("b")))
        return F.filter(each, lambda y: y["b"].isNotNull() & (F.get(e, y["a"] + 1).isNull() | (F.get(e, y["a"] + 1) != y["b"])))

    def cut(c: Column) -> Column:
        # The line of each word (of a line's first MIN_WORDS words), and for each line the one where MIN_WORDS are reached.
        line = F.flatten(F.transform(c, lambda x, i: F.array_repeat(i, x)))
        ends = let(line, lambda w: F.transform(starts(c), lambda x: F.get(w, x + (MIN_WORDS - 1))))
        return let(ends, found)

    windows = let(F.transform(n, lambda x: F.least(x, F.lit(MIN_WORDS))), cut)
    return F.when(F.size(n) > 0, windows).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def _fingerprints(h: Column, windows: Column) -> Column:
    """For each window its least hash and that line's place, the first of equal ones."""

    def one(w: Column) -> Column:
        return let(F.slice(h, w["a"] + 1, w["b"] - w["a"] + 1), lambda part: F.struct(F.array_min(part).alias("m"), (w["a"] + F.array_position(part, F.array_min(part)) - 1).cast("int").alias("at")))

    return F.transform(windows, one)


def _lines(s: Scratch, docs: DataFrame) -> DataFrame:
    """(d, uid, h, h2, at, w, f): hashes and number of each line with words, windows, their fingerprints; a table of s, a row a document."""
    def one(x: Column, at: Column) -> Column:
        bare = F.trim(x, F.lit(" \t\r\n"))
        return F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("n"), at.alias("at"))

    lines = F.filter(F.transform(_parts(F.col("text")), one), lambda x: x["n"] > 0)
    rows = docs.where(F.col("text").isNotNull()).select(*_key(), lines.alias("l"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(*KEY, F.col("l.h").alias("h"), F.col("l.h2").alias("h2"), F.col("l.at").alias("at"), _windows(F.col("l.n")).alias("w"), "row")
    rows = s.write(rows.select(*KEY, "h", "h2", "at", "w", _fingerprints(F.col("h"), F.col("w")).alias("f"), "row"), "lines")
    # Repeated rows are few, if any: only they are dealt out, not all lines.
    again = s.write(rows.groupBy(*KEY).agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("times")).where("times > 1").select(*KEY, "stays"), "lines-again")
    if again.isEmpty():
        return rows.drop("row")
    extra = rows.select(*KEY, "row").join(again, KEY).where("row <> stays").select("row")
    return s.write(rows.join(extra, "row", "left_anti").drop("row"), "lines-once")


def _run(a: str, b: str) -> str:
    """SQL of the hashes of the lines from a to b: 64 bits and, made of other hashes of the lines, 32 more."""
    return f"named_struct('a', xxhash64(slice(h, {a} + 1, {b} - {a} + 1)), 'b', hash(slice(h2, {a} + 1, {b} - {a} + 1)))"


def _again(s: Scratch, prints: DataFrame, label: str) -> DataFrame:
    """prints, a table, whose g occurs again, with `later`: whether this isn't its first place. Places are ordered by d, uid and k."""
    seen = prints.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*KEY, "k")).alias("first")).where("times > 1").select("g", "first")
    found = prints.join(s.write(seen, f"{label}-seen"), "g")
    return found.withColumn("later", F.col("first") != F.struct(*KEY, "k")).drop("first")


def _matched(s: Scratch, lines: DataFrame) -> DataFrame:
    """(d, uid, g, k): hash and number of each window whose fingerprint has another place; a table of s."""
    # Windows of one fingerprint follow each other.
    each = F.filter("f", lambda x, i: (i == 0) | (F.get("f", i - 1)["at"] != x["at"]))
    places = lines.select(F.explode(each).alias("f")).groupBy("f.m").agg(F.count(F.lit(1)).alias("times"))
    seen = s.write(places.where("times > 1").select("m"), "lines-fingerprints")
    hashed = F.expr(f"transform(w, (x, k) -> named_struct('m', get(f, k).m, 'g', {_run('x.a', 'x.b')}, 'k', k))")
    return s.write(lines.select(*KEY, F.explode(hashed).alias("x")).select(*KEY, "x.*").join(seen, "m").drop("m"), "lines-windows")


def _ranges(s: Scratch, docs: DataFrame) -> DataFrame:
    """(d, uid, a, b): first and last numbers of the lines of runs to delete; they may overlap."""
    lines = _lines(s, docs)
    windows = _again(s, _matched(s, lines), "lines")
    marks = s.write(windows.groupBy(*KEY).agg(F.collect_list(F.struct("k", "later")).alias("marks")), "lines-marks")
    steps = lambda a, b: f"IF({a} <= {b}, sequence({a}, {b}), cast(array() AS array<int>))"
    # Runs that end with the window and begin after the one before; runs that begin with it and end before the next one ends.
    longer = steps("coalesce(get(w, m.k - 1).a, -1) + 1", "x.a - 1")
    single = "x.a = x.b AND get(w, m.k + 1).a = x.b + 1 AND get(w, m.k + 1).b = x.b + 1"
    beyond = steps("x.b + 1", f"coalesce(get(w, m.k + 1).b, size(h)) - IF({single}, 0, 1)")
    entry = lambda a, b, k: f"named_struct('g', {_run(a, b)}, 'k', {k}, 'a', get(at, {a}), 'b', get(at, {b}))"
    around = f"concat(transform({longer}, i -> {entry('i', 'x.b', 'i')}), transform({beyond}, j -> {entry('x.a', 'j', 'x.a')}))"
    around = F.expr(f"flatten(transform(marks, m -> get(transform(array(get(w, m.k)), x -> {around}), 0)))")
    own = F.expr("transform(filter(marks, m -> m.later), m -> named_struct('a', get(at, get(w, m.k).a), 'b', get(at, get(w, m.k).b)))")
    held = s.write(lines.join(marks, KEY).select(*KEY, own.alias("gone"), around.alias("around")), "lines-around")
    wider = held.select(*KEY, F.explode("around").alias("f")).select(*KEY, "f.*")
    wider = _again(s, wider, "lines-wider").where("later").select(*KEY, "a", "b")
    return held.select(*KEY, F.explode("gone").alias("r")).select(*KEY, "r.a", "r.b").union(wider).distinct()


def _kept(ranges: DataFrame) -> DataFrame:
    """(d, uid, kept, next, lost): slices (a, n) of lines before and between the ranges, where the rest begins, how many lines go."""
    order = Window.partitionBy(*KEY).orderBy("a", "b")
    from_ = F.coalesce(F.max(F.col("b") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = ranges.withColumn("from", from_)
    gap = F.when(F.col("a") > F.col("from"), F.struct(F.col("from").alias("a"), (F.col("a") - F.col("from")).alias("n")))
    lost = F.greatest(F.col("b") + 1, F.col("from")) - F.greatest("a", "from")
    return gaps.groupBy(*KEY).agg(F.sort_array(F.collect_list(gap)).alias("kept"), (F.max("b") + 1).alias("next"), F.sum(lost).alias("lost"))


def _cleaned(s: Scratch, docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, text, lost, new): the given columns of each row as a struct, its text, the lines lost, and the text without them."""
    gone = s.out(_kept(_ranges(s, docs)), "lines-gone").withColumnsRenamed({k: f"_{k}" for k in KEY}).hint("shuffle_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text", *_key())
    rows = rows.join(gone, (F.col("d") == F.col("_d")) & (F.col("uid") == F.col("_uid")) & F.col("text").isNotNull(), "left")
    parts = F.when(F.col("next").isNotNull(), _parts(F.col("text")))
    rest = lambda p: F.slice(p, F.col("next") + 1, F.size(p))
    kept = let(parts, lambda p: F.concat(F.flatten(F.transform("kept", lambda k: F.slice(p, k["a"] + 1, k["n"]))), rest(p)))
    new = F.when(F.col("next").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return rows.select("row", "text", F.coalesce(F.col("lost"), F.lit(0)).alias("lost"), new.alias("new"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines_removed, n_chars_removed, text of every row."""
    with Scratch(docs.sparkSession) as s:
        out = _cleaned(s, docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"])
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    return out.select("row.doc_id", F.col("lost").cast("long").alias("n_lines_removed"), (length("text") - length("new")).cast("long").alias("n_chars_removed"), F.col("new").alias("text"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with shortened texts; n_chars, if there, follows the text. Texts that vanish leave with their rows."""
    with Scratch(docs.sparkSession) as s:
        out = _cleaned(s, docs, docs.columns).where(F.col("new").isNull() | (F.col("new") != "") | (F.col("text") == ""))
    new = {"text": F.col("new"), "n_chars": F.when(F.col("lost") > 0, F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])
