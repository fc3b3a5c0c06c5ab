"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r in [0, most], the number of times it is expected to be taken. Of all rates whose tokens meet their source's target,
those with the least entropy relative to even ones (the sum of r ln r + (most - r) ln(most - r)) are r = most / (1 + exp(-v x)), tilted exponentially in the
size x by one dual variable v a source. The dual is convex; Newton steps for all sources at once solve it, kept between the bounds found so far. Then
rates are rounded into whole copies. Built from Spark's own functions alone. Rates depend on source and size only, so all but the first and last
step runs over a table of one row for each source and size. Sums that decide are of decimals, so that no order of rows changes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.llm.blocks import Scratch
from corpusstat.llm.ranks import running

#: Weights by a source's place among the sources, repeating; tokens of the mix as a part of all; how often a document may be taken.
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps and rounds of corrections at most. Both end by themselves, as a rule after some 10.
STEPS, CORRECTIONS = 100, 40
#: Relative error of a source's expected tokens at which its dual variable is settled.
CLOSE = 1e-9


def exact(x: Column) -> Column:
    """A double as a decimal of six places, whose sums don't depend on an order."""
    return x.cast("decimal(30,6)")


def targets(tables: Scratch, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources (source, source_size, ...) with weight and target: sources in the order of their names (null last) share budget times all tokens by
    weight; a target stops at most times its source's tokens, and the excess is shared again by weight until none is above."""
    placed = running(tables, sources.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("before_place") % len(weights) + 1).cast("int"))
    table = tables.write("weighed", placed.withColumn("weight", weight).drop("before_place", "all_place", "_last"))
    limit = F.col("source_size") * float(most)
    whole = float(table.agg(F.sum("source_size")).first()[0] or 0) * budget
    each, full = 0.0, -1
    while True:  # the driver holds three numbers; each round fills one source more at least
        at_limit = F.col("weight") * F.lit(each) >= limit
        held = table.agg(F.count_if(at_limit).alias("full"), F.sum(F.when(at_limit, F.col("source_size"))).alias("taken"), F.sum(F.when(~at_limit, F.col("weight").cast("decimal(30,6)"))).alias("weight")).first()
        if held.full == full or not held.weight:
            break
        full, each = held.full, (whole - float(held.taken or 0) * most) / float(held.weight)
    return table.withColumn("target", F.least(limit, F.col("weight") * F.lit(each)))


def tilt(v: Column, x: Column, most: float) -> Column:
    """The rate at the dual variable v, for a size x."""
    return F.lit(float(most)) / (1 + F.exp(-v * x))


def balance(tables: Scratch, bins: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """sources (source, source_size, documents, target) with v, the dual variable with which bins (source, size, n) meet the target. It is null
    where the target is at an end: 0, or most times the tokens.

    A round works out, for every source that isn't settled, the expected tokens and their slope in one aggregate over the bins, and
    takes a Newton step. Where a step would leave the bounds that earlier rounds have shown, it halves them instead, so it can't diverge."""
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most))
    state = sources.select("source", "target", (F.col("source_size") / F.col("sized")).alias("mean"), F.when(open_, 0.0).alias("v"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (~open_).alias("settled"))
    state = tables.write("duals", state)
    for _ in range(STEPS):
        on = bins["source"].eqNullSafe(state["source"])
        x = F.col("size") / F.col("mean")
        rate = tilt(F.col("v"), x, most)
        tokens = F.col("n") * F.col("size")
        sums = bins.where("size > 0").join(state.where("not settled").select("source", "v", "mean"), on).select(bins["source"], exact(tokens * rate).alias("a"), exact(tokens * x * rate * (1 - rate / most)).alias("b"))
        sums = sums.groupBy("source").agg(F.sum("a").cast("double").alias("had"), F.sum("b").cast("double").alias("slope")).withColumnRenamed("source", "_of")
        gap = F.col("target") - F.col("had")
        low = F.when(gap > 0, F.greatest("low", "v")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.least("high", "v")).otherwise(F.col("high"))
        to = state.join(sums, state["source"].eqNullSafe(sums["_of"]), "left").withColumns({"_low": low, "_high": high, "_newton": F.col("v") + F.try_divide(gap, F.col("slope"))})
        inside = F.col("_newton").isNotNull() & ~F.isnan("_newton") & (F.abs(F.col("_newton") - F.col("v")) <= 4 + F.abs("v")) & (F.col("_newton") > F.coalesce("_low", F.lit(float("-inf")))) & (F.col("_newton") < F.coalesce("_high", F.lit(float("inf"))))
        wide = F.when(gap > 0, F.col("v") + 2 + F.abs("v")).otherwise(F.col("v") - 2 - F.abs("v"))
        stepped = F.when(inside, F.col("_newton")).otherwise(F.coalesce((F.col("_low") + F.col("_high")) / 2, wide))
        done = F.col("settled") | F.coalesce(F.abs(gap) <= F.greatest(F.col("target") * CLOSE, F.lit(1e-6)), F.lit(True)) | F.coalesce(F.col("_high") - F.col("_low") <= F.abs("v") * 1e-15, F.lit(False))
        state = tables.write("duals", to.select("source", "target", "mean", F.when(done, F.col("v")).otherwise(stepped).alias("v"), F.col("_low").alias("low"), F.col("_high").alias("high"), done.alias("settled")))
        if state.where("not settled").isEmpty():
            break
    return state.select("source", "target", "mean", "v")


def rounded(tables: Scratch, bins: DataFrame, duals: DataFrame, most: int = MOST) -> DataFrame:
    """bins (source, size, n) with rate and copies: whole numbers, from 0 to most * n, whose tokens come as near to each source's target as corrections bring them.

    Expected copies are summed up by source from the largest size down, and each bin takes the whole numbers that the sum passes. A source
    then is off by less than its largest document; rounds of corrections add or take copies of the one size that brings it nearest, until none helps."""
    known = bins.join(duals.withColumnRenamed("source", "_of"), bins["source"].eqNullSafe(F.col("_of"))).drop("_of")
    ended = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    known = known.withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(tilt(F.col("v"), F.col("size") / F.col("mean"), most), ended)))
    known = tables.write("rates", known.drop("mean", "v"))
    # Sizes of one source may be many, so the sum runs over ranges.
    summed = running(tables, known, ["source"], [-F.col("size")], {"expected": exact(F.col("n") * F.col("rate"))})
    passed = lambda c: F.floor(c + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    upto = F.col("before_expected") + exact(F.col("n") * F.col("rate"))
    first = F.least(passed(upto) - passed(F.col("before_expected")), F.col("n") * most)
    now = tables.write("copies", summed.withColumn("copies", F.greatest(first, F.lit(0).cast("long"))).drop("before_expected", "all_expected"))
    for _ in range(CORRECTIONS):
        off = now.groupBy(F.col("source").alias("_of")).agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).where("gap <> 0")
        fits = now.where("size > 0").join(off, now["source"].eqNullSafe(F.col("_of")))
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        times = F.greatest(F.lit(1).cast("long"), F.least(room, F.round(F.abs("gap") / F.col("size")).cast("long")))
        tried = fits.where(room > 0).withColumn("times", times).withColumn("left", F.abs(F.abs("gap") - F.col("times") * F.col("size"))).where(F.col("left") < F.abs("gap"))
        best = tried.groupBy("_of").agg(F.min(F.struct("left", "size", (F.signum("gap") * F.col("times")).cast("long").alias("more"))).alias("best")).select("_of", F.col("best.size").alias("_size"), "best.more")
        best = tables.write("corrections", best)
        if best.isEmpty():
            break
        on = now["source"].eqNullSafe(best["_of"]) & (now["size"] == best["_size"])
        now = tables.write("copies", now.join(best, on, "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("_of", "_size", "more"))
    return now


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, source, size (words), source_size, target (its source's), rate and copies, the times that it is taken.

    Of the documents of one source and size, copies differ by one at most, and those with the least hash of their id have the one more; equal ids tie, so which
    of their rows has it isn't fixed, but as rows they are the same. No draw is random: reruns agree, whatever the partitions. A null source is a source, the last one; a null or
    empty text has no words and is taken 0 times; a null id is an id; repeated rows are rows of their own; where no row has a word all targets are 0; no
    rows give no rows. Columns that aren't named are ignored."""
    tables = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = tables.write("sizes", rows)
    placed = tables.write("placed", running(tables, rows, ["source", "size"], [F.xxhash64("id")], {"rows": F.lit(1).cast("long")}))
    tables.drop("sizes", "ranged")
    bins = tables.write("bins", placed.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = bins.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("sized"))
    aims = tables.write("targets", targets(tables, sources, weights, budget, most))
    done = rounded(tables, bins, balance(tables, bins, aims, most), most)
    # One row for each source and size meets documents that were counted by both, so no source is one key.
    dealt = done.join(aims.select(F.col("source").alias("_of"), "source_size"), done["source"].eqNullSafe(F.col("_of"))).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "rate", "copies", "source_size", "target")
    dealt = tables.write("dealt", dealt)
    out = placed.join(dealt, placed["source"].eqNullSafe(F.col("_source")) & (placed["size"] == F.col("_size")))
    copies = F.expr("copies div n") + (F.col("before_rows") < F.expr("copies % n")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", copies.alias("copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """A row for each copy, numbered from 1; rows with no copy go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
