"""Shares, surge, lift, concentration, emergence, divergence and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.operators.ordered import cumulative


def shares(df: DataFrame, by: list[str], hit: Column, w: str) -> DataFrame:
    """Weighted share of hits over all rows of each group."""
    return df.groupBy(*by).agg((F.sum(F.when(hit, F.col(w)).otherwise(0.0)) / F.sum(w)).alias("share"), F.count("*").alias("n"))


def event_shares(df: DataFrame, day: str, hit: Column, w: str, events: list[tuple[str, str]], width: int) -> DataFrame:
    """Shares in the width days before and from each event on; windows of events may overlap."""
    spark = df.sparkSession
    table = spark.createDataFrame(events, "event string, at string").withColumn("at", F.to_date("at"))
    gap = F.datediff(F.to_date(day), "at")
    joined = df.withColumn("_hit", hit).join(F.broadcast(table), (gap >= -width) & (gap < width))
    return shares(joined.withColumn("side", F.when(gap < 0, "before").otherwise("after")), ["event", "side"], F.col("_hit"), w)


def surge(df: DataFrame, series: str, period: str, baseline: Column, w: str) -> DataFrame:
    """Share in a period / share in the baseline; null where the baseline's is 0."""
    cells = df.groupBy(series, period).agg(F.sum(w).alias("x"), F.sum(F.when(baseline, F.col(w)).otherwise(0.0)).alias("x0"))
    totals = cells.groupBy(period).agg(F.sum("x").alias("t"))
    base = cells.groupBy(series).agg(F.sum("x0").alias("b")).crossJoin(F.broadcast(cells.agg(F.sum("x0").alias("b_all"))))  # one row
    out = cells.join(totals, period).join(base, series)
    return out.select(series, period, (F.col("x") / F.col("t")).alias("share"), F.when(F.col("b") > 0, F.col("x") / F.col("t") / (F.col("b") / F.col("b_all"))).alias("ssi"))


def lift(df: DataFrame, item: str, group: str, w: str, min_n: int) -> DataFrame:
    """Share of an item within a group / its share in all, for items with at least min_n rows in the group. Rows are distinct (item, unit)."""
    cells = df.groupBy(item, group).agg(F.count("*").alias("n"), F.sum(w).alias("x"))
    items, groups = cells.groupBy(item).agg(F.sum("x").alias("xi")), cells.groupBy(group).agg(F.sum("x").alias("xg"))
    total = cells.agg(F.sum("x").alias("xa"))
    out = cells.where(F.col("n") >= min_n).join(items, item).join(groups, group).join(F.broadcast(total))
    return out.select(item, group, "n", (F.col("x") / F.col("xg") / (F.col("xi") / F.col("xa"))).alias("lift"))


def concentration(df: DataFrame, by: list[str], unit: str, w: str, regions: int | None = None, top: int = 3) -> DataFrame:
    """HHI, its value normalised for a number of regions, effective number, share of the largest units."""
    cells = df.groupBy(*by, unit).agg(F.sum(w).alias("x"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("x"), unit))
    total = F.sum("x").over(W.partitionBy(*by))
    out = cells.withColumns({"p": F.col("x") / total, "rank": rank}).groupBy(*by).agg(F.sum(F.col("p") * F.col("p")).alias("hhi"), F.sum(F.when(F.col("rank") <= top, F.col("p"))).alias("top_share"), F.count("*").alias("units"))
    out = out.withColumn("effective", 1 / F.col("hhi"))
    return out.withColumn("hhi_norm", (F.col("hhi") - 1 / regions) / (1 - 1 / regions)) if regions else out


def emergence(series: DataFrame, unit: str, period: str, share: str, low: str, high: str, line: float) -> DataFrame:
    """First period at or above the line, clearly new (all before clearly below), returning after a dip, and how many later periods stay clearly above."""
    w = W.partitionBy(unit).orderBy(period)
    past, future = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    above = F.col(share) >= line
    return series.withColumns({
        "first_above": F.min(F.when(above, F.col(period))).over(W.partitionBy(unit)),
        "clearly_new": (F.col(low) >= line) & (F.max(high).over(past) < line),
        "returning": above & (F.lag(share).over(w) < line) & (F.max(share).over(past) >= line),
        "later_above": F.count(F.when(F.col(low) >= line, 1)).over(future),
    })


def divergence(df: DataFrame, category: str, side: Column) -> DataFrame:
    """Jensen-Shannon (base 2) and total variation between the rows where side holds and the others."""
    cells = df.groupBy(category).agg(F.sum(F.when(side, 1).otherwise(0)).alias("a"), F.sum(F.when(side, 0).otherwise(1)).alias("b"))
    totals = cells.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.try_divide("a", "ta"), F.try_divide("b", "tb")
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return cells.join(F.broadcast(totals)).agg(((F.sum(part(p)) + F.sum(part(q))) / 2).alias("js"), (F.sum(F.abs(p - q)) / 2).alias("tv"))


def ks(df: DataFrame, value: str, side: Column) -> DataFrame:
    """Largest distance of two cumulative distributions, over sums by value that are cumulated range by range."""
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(F.when(side, 1).otherwise(0)).alias("a"), F.sum(F.when(side, 0).otherwise(1)).alias("b"))
    totals = cells.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    gaps = cumulative(cells, value, ["a", "b"]).join(F.broadcast(totals))  # one row
    return gaps.agg(F.max(F.abs(F.try_divide("upto_a", "ta") - F.try_divide("upto_b", "tb"))).alias("ks"))


def agreement(df: DataFrame, truth: str, said: str, w: str, levels: int | None = None) -> DataFrame:
    """Cohen's kappa, quadratic-weighted if levels (labels are then whole numbers) are given; null where chance agreement is complete. Chance comes from
    sums over labels, never from pairs of them."""
    cells = df.groupBy(truth, said).agg(F.sum(w).alias("x"))
    if levels:
        a, b, x = F.col(truth), F.col(said), F.col("x")
        sums = cells.agg(F.sum("x").alias("t"), F.sum(x * F.pow(a - b, 2)).alias("seen"), *(F.sum(x * c).alias(n) for n, c in (("a1", a), ("a2", a * a), ("b1", b), ("b2", b * b))))
        chance = F.col("t") * F.col("a2") - 2 * F.col("a1") * F.col("b1") + F.col("t") * F.col("b2")
    else:
        rows, cols = cells.groupBy(truth).agg(F.sum("x").alias("r")), cells.groupBy(F.col(said).alias(truth)).agg(F.sum("x").alias("c"))
        same = rows.join(cols, truth).agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0.0)).alias("same"))
        sums = cells.agg(F.sum("x").alias("t"), F.sum(F.when(F.col(truth) == F.col(said), 0.0).otherwise(F.col("x"))).alias("seen")).join(F.broadcast(same))  # one row
        chance = F.col("t") * F.col("t") - F.col("same")
    return sums.select(F.when(chance > 0, 1 - F.col("seen") * F.col("t") / chance).alias("kappa"))


def precision_recall(df: DataFrame, truth: str, said: str, w: str) -> DataFrame:
    """Weighted precision, recall and F1 by class; undefined recall gives no F1, no true positive gives 0."""
    cells = df.groupBy(truth, said).agg(F.sum(w).alias("x"))
    sides = cells.select(F.col(truth).alias("label"), F.lit(0.0).alias("p"), F.col("x").alias("t"), F.when(F.col(truth) == F.col(said), F.col("x")).otherwise(0.0).alias("tp"))
    sides = sides.union(cells.select(F.col(said), F.col("x"), F.lit(0.0), F.lit(0.0)))
    out = sides.groupBy("label").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("tp").alias("tp"))
    precision, recall = F.when(F.col("p") > 0, F.col("tp") / F.col("p")), F.when(F.col("t") > 0, F.col("tp") / F.col("t"))
    return out.select("label", precision.alias("precision"), recall.alias("recall"), F.when(F.col("t") > 0, 2 * F.col("tp") / (F.col("p") + F.col("t"))).alias("f1"))
