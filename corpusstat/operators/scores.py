"""Scoring of taggers, annotators, inferred skills and labelings, and reference levels for divergences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.operators.estimate import agreement

from corpusstat.operators.resample import uniform


def macro_scores(df: DataFrame, truth: str, said: str, flagged: str, w: str, intensity: tuple[str, str]) -> DataFrame:
    """Macro-F1 over the classes that the flagged rows' truth has (but none), lexicon precision (flagged weight whose truth isn't none), lexicon miss (unflagged
    weight whose truth isn't none), and the weighted agreement of intensity where both name the same class."""
    fl = df.where(F.coalesce(F.col(flagged), F.lit(False)))
    cells = fl.groupBy(truth, said).agg(F.sum(w).alias("_x"))
    right = F.when(F.col(truth) == F.col(said), F.col("_x")).otherwise(0.0)
    sides = cells.select(F.col(truth).alias("label"), F.col("_x").alias("t"), F.lit(0.0).alias("p"), right.alias("tp")).union(cells.select(F.col(said), F.lit(0.0), F.col("_x"), F.lit(0.0)))
    by = sides.where("label <> 'none'").groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp")).where("t > 0")
    macro = by.agg(F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"), F.count("*").alias("classes"))
    part = lambda rows, hit, name: rows.agg((F.sum(F.when(hit, F.col(w)).otherwise(0.0)) / F.sum(w)).alias(name))
    precision = part(fl, F.col(truth) != "none", "lexicon_precision")
    miss = part(df.where(~F.coalesce(F.col(flagged), F.lit(False))), F.col(truth) != "none", "lexicon_miss")
    same = fl.where((F.col(truth) == F.col(said)) & ~F.col(truth).isin("none", "invalid") & F.col(intensity[0]).isNotNull() & F.col(intensity[1]).isNotNull())
    out = macro
    for one in (precision, miss, part(same, F.col(intensity[0]) == F.col(intensity[1]), "intensity_agreement")):
        out = out.join(F.broadcast(one))  # one row each
    return out


def two_passes(first: DataFrame, second: DataFrame, key: str, label: str, level: str | None = None, levels: tuple = ("low", "medium", "high"), no_level: tuple = ("none", "unclear")) -> DataFrame:
    """Rows that both passes labelled, agreement, and Cohen's kappa of the two; with `level` (the intensity's column) also, of the rows with one label both times (not one of no_level) and a level both
    times, their number (n_level) and the quadratic-weighted kappa of their levels, null where chance agreement is complete. Keys are distinct in each pass."""
    names = [label] + ([level] if level else [])
    both = first.select(key, *(F.col(c).alias(f"a{i}") for i, c in enumerate(names))).join(second.select(key, *(F.col(c).alias(f"b{i}") for i, c in enumerate(names))), key).where("a0 <> '' and b0 <> ''")
    cells = both.groupBy(F.col("a0").alias("a"), F.col("b0").alias("b")).agg(F.count("*").alias("x"))
    n = cells.agg(F.sum("x").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("x")).otherwise(0)) / F.sum("x")).alias("agreement"))
    rows, cols = cells.groupBy("a").agg(F.sum("x").alias("r")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("x").alias("c"))
    chance = rows.join(cols, "a").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("_e"))
    out = n.join(F.broadcast(chance))  # one row
    e = F.col("_e") / (F.col("n") * F.col("n"))
    out = out.select("n", "agreement", F.when(e < 1, (F.col("agreement") - e) / (1 - e)).alias("kappa"))
    if not level:
        return out
    place = lambda c: F.array_position(F.array(*map(F.lit, levels)), F.col(c))
    placed = both.where((F.col("a0") == F.col("b0")) & ~F.col("a0").isin(*no_level)).select(place("a1").alias("p"), place("b1").alias("q"), F.lit(1.0).alias("w")).where("p > 0 and q > 0")
    weighted = agreement(placed, "p", "q", "w", len(levels)).withColumnRenamed("kappa", "kappa_level")
    return out.join(F.broadcast(placed.agg(F.count("*").alias("n_level")))).join(F.broadcast(weighted))  # one row each


def skill_validation(df: DataFrame, key: str, own: str, inferred: str) -> DataFrame:
    """Mean recall and precision of each row's inferred items against its own, and of another row's inferred items (the next one in the order of a hash) as
    the level of chance. Items are arrays; rows without own or inferred items don't count."""
    rows = df.where((F.size(own) > 0) & (F.size(inferred) > 0)).select(F.xxhash64(key).alias("_h"), F.array_distinct(own).alias("o"), F.array_distinct(inferred).alias("i"))
    # a neighbour by hash within one of many parts, so that no task orders all rows
    part = W.partitionBy(F.pmod("_h", F.lit(1024))).orderBy("_h")
    other = F.coalesce(F.lead("i").over(part), F.first("i").over(part))
    rows = rows.withColumn("r", other)
    both = lambda c: F.size(F.array_intersect("o", c))
    return rows.agg(F.count("*").alias("n"), F.avg(both("i") / F.size("o")).alias("recall"), F.avg(both("i") / F.size("i")).alias("precision"),
                    F.avg(both("r") / F.size("o")).alias("random_recall"), F.avg(both("r") / F.size("r")).alias("random_precision"))


def split_floor(df: DataFrame, key: str, category: str, splits: int = 300, least: int = 40, seed: int = 1) -> DataFrame:
    """95th percentile of the Jensen-Shannon divergence (base 2) of random half splits; null under `least` rows. Each row falls into a half by a hash of
    split and row, and counts by split and category meet, not rows."""
    rows = df.select(key, F.col(category).alias("_c"))
    n = rows.agg(F.count("*").alias("n"))
    halves = rows.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits)))).withColumn("_a", uniform(seed, F.col("split"), F.col(key)) < 0.5)
    cells = halves.groupBy("split", "_c").agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("b"))
    total = cells.groupBy("split").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.try_divide("a", "ta"), F.try_divide("b", "tb")
    one = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    js = cells.join(total, "split").groupBy("split").agg(((F.sum(one(p)) + F.sum(one(q))) / 2).alias("js"))
    out = js.agg(F.percentile("js", 0.95).alias("_q")).join(F.broadcast(n))  # one row
    return out.select("n", F.when(F.col("n") >= least, F.col("_q")).alias("floor"))


def drift_reference(df: DataFrame, period: str, category: str, side: Column) -> DataFrame:
    """The largest divergence of adjacent periods on one side, the divergence between the sides, and whether that is beyond the drift."""
    rows = df.select(F.col(period).alias("p"), F.col(category).alias("c"), side.alias("s"))
    cells = rows.groupBy("s", "p", "c").agg(F.count("*").alias("n"))
    places = cells.select("s", "p").distinct().withColumn("i", F.row_number().over(W.partitionBy("s").orderBy("p")))  # periods of a calendar
    placed = cells.join(places, ["s", "p"]).select("s", "i", "c", "n")
    steps = placed.select("s", "i", "c", F.col("n").alias("a"), F.lit(0).alias("b")).union(placed.select("s", F.col("i") - 1, "c", F.lit(0), "n"))
    ends = places.groupBy("s").agg(F.max("i").alias("_last"))
    steps = steps.join(F.broadcast(ends), "s").where("i >= 1 and i < _last")
    drift = divergences(steps, ["s", "i"]).agg(F.max("js").alias("drift"))
    event = divergences(cells.select("c", F.when(F.col("s"), F.col("n")).otherwise(0).alias("a"), F.when(F.col("s"), 0).otherwise(F.col("n")).alias("b")), []).select(F.col("js").alias("event"))
    return event.join(F.broadcast(drift)).select("event", "drift", (F.col("event") > F.col("drift")).alias("beyond"))  # one row


def divergences(cells: DataFrame, by: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of counts a and b over c in each group."""
    sums = cells.groupBy(*by, "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = sums.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    joined = sums.join(totals, by) if by else sums.join(F.broadcast(totals))
    p, q = F.try_divide("a", "ta"), F.try_divide("b", "tb")
    one = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return joined.groupBy(*by).agg(((F.sum(one(p)) + F.sum(one(q))) / 2).alias("js"))


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted mutual information of two labelings (arithmetic mean of the entropies). The expected value is a sum over pairs of distinct group sizes,
    whose numbers are far smaller than the labels'."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("t"))
    mi = cells.join(rows, "a").join(cols, "b").join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"))
    entropy = lambda df, c, name: df.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    sizes = rows.groupBy("ra").agg(F.count("*").alias("ka")).crossJoin(cols.groupBy("cb").agg(F.count("*").alias("kb"))).join(F.broadcast(total))  # distinct sizes by distinct sizes

    @F.pandas_udf("double")
    def expected(ra, cb, t):
        out = []
        for x, y, n in zip(ra.to_numpy(), cb.to_numpy(), t.to_numpy()):
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            lg = lambda v: np.array([math.lgamma(u + 1) for u in np.atleast_1d(v)])
            log_p = lg(x) + lg(y) + lg(n - x) + lg(n - y) - lg(n) - lg(k) - lg(x - k) - lg(y - k) - lg(n - x - y + k)
            out.append(float((k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum()))
        import pandas as pd

        return pd.Series(out)

    emi = sizes.agg(F.sum(F.col("ka") * F.col("kb") * expected("ra", "cb", "t")).alias("emi"))
    out = mi
    for one in (entropy(rows, "ra", "ha"), entropy(cols, "cb", "hb"), emi):
        out = out.join(F.broadcast(one))  # one row each
    top = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    return out.select(F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("mi") - F.col("emi")) / top).alias("ami"))
