"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Each source has a token target. Among all non-negative document rates that meet the targets, entropy balancing
takes those nearest to 1 in relative entropy: rate = exp(lambda[source] * size / mean size of the source), at most `cap`.
The multipliers solve a convex dual; Newton steps, kept inside a bracket, run over a (source, size) histogram, so an
iteration touches one row for each distinct size and not the documents. Rates are then rounded to whole copies in the
histogram, sizes descending, such that rounding errors cancel; what is left of a target is spent on ever smaller documents,
then by swapping a copy of one size for a copy of the size that comes nearest. Copies are dealt to documents by a hash of
their id and text.

Nulls and edges: a null text has size 0 and takes 0; a null source is a source of its own, the last one; size-0
documents keep rate 1; an empty table gives an empty result. Extra columns pass through, whatever their names. Repeated rows
are separate documents, of which any may be the one that is taken once more. Sources are numbered by range partitions, so
that no task meets all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target and a document's words stop at so many times the size.
CAP = 3
#: Relative error of a source's tokens at which Newton steps end, and the most steps.
TOLERANCE, STEPS = 1e-7, 60
#: Documents of a (source, size) group are ranked in so many hash blocks, not in one task.
BLOCKS = 1024
#: Newton steps between two written states.
AT_ONCE = 4
#: Passes that spend what rounding left of a target on ever smaller documents, and swaps after them.
REPAIRS, SWAPS = 4, 3


def _numbered(s: Scratch, per: DataFrame) -> DataFrame:
    """per with `number`, its sources' places in order from 0; nulls ("n", which sorts before "s...") are last."""
    order = [(F.col("skey") == "n"), F.col("skey")]
    dealt = per.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = s.write(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "mix-sources")
    # A row for each partition.
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(parts.select("part", "least", before.alias("before")), "part").withColumn("number", F.col("row") - F.col("least") + F.col("before")).drop("part", "row", "least", "before")


def source_targets(s: Scratch, hist: DataFrame) -> DataFrame:
    """(skey, source_size, docs, weight, target), a table of s, from rows (skey, size, n)."""
    per = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = s.write(_numbered(s, per).withColumn("weight", F.get(weights, (F.col("number") % len(WEIGHTS)).cast("int"))).drop("number"), "mix-weights")
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0  # words a unit of weight gets
    while True:
        full = F.col("weight") * F.lit(level) >= CAP * F.col("source_size")
        spent, weight = per.agg(
            F.coalesce(F.sum(F.when(full, CAP * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if not weight or (new := (total - spent) / weight) <= level:
            break
        level = new
    return s.write(per.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), CAP * F.col("source_size").cast("double"))), "mix-targets")


def _step(hist: DataFrame, state: DataFrame) -> DataFrame:
    """state after a damped Newton step on the dual, with the error before it: one aggregate over the histogram."""
    z = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
    words = F.col("n") * F.col("size")
    keys = ["skey", "target", "mean", "full", "lam", "lo", "hi"]
    step = hist.join(state.select(*keys), "skey").groupBy(*keys).agg(
        F.sum(words * F.least(F.lit(float(CAP)), raw)).alias("got"),
        F.sum(F.when(raw < CAP, words * z * raw).otherwise(0.0)).alias("slope"),
    )
    step = step.withColumn("error", F.when(F.col("full"), 0.0).otherwise(F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))))
    below = F.col("got") < F.col("target")
    step = step.withColumns({"lo": F.when(below, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(below, F.col("hi")).otherwise(F.col("lam"))})
    newton = F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope")
    inside = (F.col("slope") > 0) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton - F.col("lam")) <= 2)
    other = (
        F.when(F.col("hi").isNull(), F.col("lam") + 1)
        .when(F.col("lo").isNull(), F.col("lam") - 1)
        .otherwise((F.col("lo") + F.col("hi")) / 2)
    )
    return step.withColumn("lam", F.when(F.col("error") <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise(other)).select(*keys, "error")


def _rates(s: Scratch, hist: DataFrame, sources: DataFrame) -> DataFrame:
    """hist with target and rate."""
    state = sources.select(
        "skey",
        "target",
        F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("mean"),
        (F.col("target") >= CAP * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
    )
    for _ in range(0, STEPS, AT_ONCE):
        for _ in range(AT_ONCE):
            state = _step(hist, state)
        state = s.write(state, "mix-state")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    z = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(CAP)).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("lam") * z, F.lit(700.0)))))
    return hist.join(state, "skey").select("skey", "size", "n", "target", rate.alias("rate"))


def _copies(s: Scratch, rated: DataFrame) -> DataFrame:
    """Whole copies for each (source, size): rounded along descending size, then repaired towards the target."""
    down = Window.partitionBy("skey").orderBy(F.col("size").desc())
    until = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("skey")
    df = rated.withColumn("along", F.round(F.sum(F.col("n") * F.col("rate")).over(until)))
    df = df.withColumn("copies", (F.col("along") - F.coalesce(F.lag("along").over(down), F.lit(0.0))).cast("long"))
    df = df.withColumn("copies", F.greatest(F.lit(0).cast("long"), F.least(F.col("copies"), CAP * F.col("n"))))
    left = F.round(F.col("target")) - F.sum(F.col("copies") * F.col("size")).over(whole)
    for _ in range(REPAIRS):
        df = df.withColumn("left", left)
        room = F.when(F.col("left") > 0, CAP * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left"))
        df = df.withColumn("room", F.when(fits, room * F.col("size")).otherwise(0))
        df = df.withColumn("open", F.abs("left") - (F.sum("room").over(until) - F.col("room")))
        move = F.when(fits & (F.col("open") > 0), F.least(room, F.floor(F.col("open") / F.col("size")))).otherwise(0)
        df = df.withColumn("copies", (F.col("copies") + F.signum("left") * move).cast("long"))
    df = s.write(df.select("skey", "size", "n", "target", "rate", "copies"), "mix-rounded")
    for _ in range(SWAPS):
        df = s.write(_swapped(df.withColumn("left", left)), "mix-swapped")
    return df


def _swapped(df: DataFrame) -> DataFrame:
    """df with one copy of each source swapped for one of another size, if that brings its words nearer to the target.

    Each size that gives a copy looks up the sizes next to its own plus what is left, in order of size. Size 0 gives and
    takes any number, so that a copy can be added or removed alone.
    """
    none = df.groupBy("skey").agg(F.first("left").alias("left")).select("skey", "left", F.lit(0).cast("long").alias("size"))
    gives = df.where((F.col("copies") > 0) & (F.col("size") > 0)).select("skey", "left", "size").unionByName(none)
    takes = df.where((F.col("copies") < CAP * F.col("n")) & (F.col("size") > 0)).select("skey", "left", "size").unionByName(none)
    size = F.col("size").cast("long")
    both = gives.select("skey", "left", size.alias("from"), F.lit(None).cast("long").alias("to"), (F.col("size") + F.col("left")).alias("at")).unionByName(
        takes.select("skey", "left", F.lit(None).cast("long").alias("from"), size.alias("to"), F.col("size").cast("double").alias("at"))
    )
    up = Window.partitionBy("skey").orderBy("at", F.col("from").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("skey").orderBy("at", F.col("from").isNull()).rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("to", F.array(F.last("to", True).over(up), F.first("to", True).over(over))).where(F.col("from").isNotNull())
    near = near.select("skey", "left", "from", F.explode("to").alias("to")).where(F.col("to").isNotNull() & (F.col("to") != F.col("from")))
    off = F.abs(F.col("left") - (F.col("to") - F.col("from")))
    best = near.where(off < F.abs("left")).groupBy("skey").agg(F.min(F.struct(off.alias("off"), "from", "to")).alias("best"))
    change = F.when(F.col("size") == 0, 0).otherwise((F.coalesce(F.col("best.to") == F.col("size"), F.lit(False))).cast("int") - (F.coalesce(F.col("best.from") == F.col("size"), F.lit(False))).cast("int"))
    return df.join(best, "skey", "left").select("skey", "size", "n", "target", "rate", (F.col("copies") + change).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """(row, size, source_size, target, rate, copies): each row of docs as a struct, and what the mix makes of it (0 to CAP copies)."""
    with Scratch(docs.sparkSession) as s:
        rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col("doc_id"), F.col("text")).alias("hash"),
        )
        return _mixed(s, rows)


def _mixed(s: Scratch, rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("block", F.pmod("hash", F.lit(BLOCKS)).cast("int"))
    blocks = s.write(rows.groupBy("skey", "size", "block").agg(F.count(F.lit(1)).alias("n")), "mix-blocks")
    hist = s.write(blocks.groupBy("skey", "size").agg(F.sum("n").alias("n")), "mix-hist")
    sources = source_targets(s, hist)
    plan = _copies(s, _rates(s, hist, sources)).join(sources.select("skey", "source_size"), "skey").withColumnRenamed("n", "all")
    before = Window.partitionBy("skey", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("skey", "size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(plan, ["skey", "size"])
    placed = s.out(placed, "mix-plan")
    within = Window.partitionBy("skey", "size", "block").orderBy("hash")
    out = rows.join(placed, ["skey", "size", "block"]).withColumn("rank", F.row_number().over(within) + F.col("before"))
    each = F.floor(F.col("copies") / F.col("all"))
    copies = each + F.when(F.col("rank") <= F.col("copies") - each * F.col("all"), 1).otherwise(0)
    return out.select("row", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken; then source, rate and copies."""
    with Scratch(docs.sparkSession) as s:
        slim = docs.select(
            F.struct("doc_id", "source").alias("row"),
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col("doc_id"), F.col("text")).alias("hash"),
        )
        out = _mixed(s, s.out(slim, "mix-sizes"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "row.source", "rate", "copies")


def apply(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns stay."""
    mixed = mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])
