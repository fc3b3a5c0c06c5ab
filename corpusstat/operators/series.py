"""The core report: clusters by period, emergence, summaries, concentration by region, and their intervals."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cluster_series(df: DataFrame, cluster: str, day: str, w: str, period: Callable, first: Callable, last: Callable, min_days: int) -> DataFrame:
    """For each cluster and period rows taken, share, weighted and coverage-adjusted numbers (times calendar days over sampled days; the first and
    last period are clipped to the days that were sampled). Cells without rows are 0. period, first and last give a day's period and its bounds.

    Rows are summed to cluster and day first, so all that follows is as long as the calendar. A day counts as its weight times the cluster's part of its rows."""
    cells = df.groupBy(F.col(cluster).alias("cluster"), F.to_date(day).alias("_day")).agg(F.count("*").alias("_c"), F.sum(w).alias("_w"))
    days = cells.groupBy("_day").agg(F.sum("_c").alias("_n"), F.sum("_w").alias("_day_w"))
    at = F.col("_day")
    days = days.select("*", period(at).alias("period"), first(at).alias("_first"), last(at).alias("_last"))
    ends = days.agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"))
    spans = days.groupBy("period").agg(F.count("*").alias("days"), F.sum("_day_w").alias("population"), F.first("_first").alias("_f"), F.first("_last").alias("_l"))
    calendar = (F.datediff(F.least("_l", "_hi"), F.greatest("_f", "_lo")) + 1).cast("long")
    spans = spans.join(F.broadcast(ends)).select("period", "days", "population", calendar.alias("calendar_days"))  # one row
    taken = cells.join(days.select("_day", "period", "_n", "_day_w"), "_day").groupBy("cluster", "period")
    taken = taken.agg(F.sum("_c").alias("taken"), F.sum(F.col("_day_w") * F.col("_c") / F.col("_n")).alias("weighted"))
    grid = cells.select("cluster").distinct().crossJoin(F.broadcast(spans))  # clusters by periods of the calendar: every cell of the report
    out = grid.join(taken, ["cluster", "period"], "left").fillna(0, ["taken", "weighted"])
    adjusted = F.col("weighted") * F.col("calendar_days") / F.col("days")
    return out.select("cluster", "period", "days", "calendar_days", "taken", (F.col("weighted") / F.col("population")).alias("share"), "weighted",
                      adjusted.alias("adjusted"), (F.col("days") >= min_days).alias("usable"))


def first_crossings(series: DataFrame, line: float, value: str = "adjusted") -> DataFrame:
    """Each cluster's first usable period at or above the line (clusters of 0 or more)."""
    return series.where(F.col("usable") & (F.col("cluster") >= 0) & (F.col(value) >= line)).groupBy("cluster").agg(F.min("period").alias("first_cross"))


def emergence_rate(series: DataFrame, line: float, value: str = "adjusted") -> DataFrame:
    """Per usable period the clusters at or above the line, and those that cross it for the first time; in the first usable period none is new."""
    real = series.where(F.col("usable") & (F.col("cluster") >= 0))
    active = real.groupBy("period").agg(F.count_if(F.col(value) >= line).alias("active"))
    new = first_crossings(series, line, value).groupBy(F.col("first_cross").alias("period")).agg(F.count("*").alias("_new"))
    begun = real.agg(F.min("period").alias("_first"))
    out = active.join(new, "period", "left").join(F.broadcast(begun))  # one row
    return out.select("period", "active", F.when(F.col("period") == F.col("_first"), 0).otherwise(F.coalesce("_new", F.lit(0))).cast("long").alias("new"))


def region_concentration(df: DataFrame, cluster: str, period: Column, region: str, w: str, regions: int, least: int) -> DataFrame:
    """HHI over regions for each cluster and period, each cluster over all periods, and ALL clusters: rows placed, HHI, its value normalised for the
    number of regions, the unplaced share of the weight, and whether enough rows are placed."""
    rows = df.select(F.col(cluster).cast("string").alias("cluster"), period.alias("period"), F.nullif(F.col(region), F.lit("")).alias("_region"), F.col(w).alias("_w"))
    cells = rows.groupBy("cluster", "period", "_region").agg(F.count("*").alias("_n"), F.sum("_w").alias("_w"))
    both = cells.select(F.explode(F.array(F.col("cluster"), F.lit("ALL"))).alias("cluster"), "period", "_region", "_n", "_w")
    wide = both.select("cluster", F.explode(F.array("period", F.lit("all"))).alias("period"), "_region", "_n", "_w")
    sums = wide.groupBy("cluster", "period", "_region").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"))
    placed = F.col("_region").isNotNull()
    one = lambda c: F.sum(F.when(placed, c))
    out = sums.groupBy("cluster", "period").agg(F.coalesce(one(F.col("_n")), F.lit(0)).alias("placed"), one(F.col("_w")).alias("_p"), one(F.col("_w") * F.col("_w")).alias("_sq"), F.sum("_w").alias("_all"))
    hhi = F.when(F.col("_p") > 0, F.col("_sq") / (F.col("_p") * F.col("_p")))
    unplaced = F.when(F.col("_all") > 0, 1 - F.coalesce("_p", F.lit(0.0)) / F.col("_all"))
    return out.select("cluster", "period", "placed", hhi.alias("hhi"), ((hhi - 1 / regions) / (1 - 1 / regions)).alias("hhi_norm"), unplaced.alias("unplaced_share"), (F.col("placed") >= least).alias("reliable"))


def cluster_summary(df: DataFrame, series: DataFrame, cluster: str, w: str, channel: str, template: Column, title: str, line: float) -> DataFrame:
    """Per cluster rows, weight, the peak period, its first crossing, the flagged share of the weight, the top channel and its part of the flagged,
    the share of the most frequent template, the titleless share and the three most frequent titles (ties by name, W14)."""
    own = [F.col(cluster).alias("cluster")]
    part = lambda name, key, value, n: (  # the n largest values of a group, as (rank, key, sum)
        df.where(key.isNotNull()).groupBy(*own, key.alias(name)).agg(value.alias("_v"))
        .withColumn("_rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("_v"), name))).where(F.col("_rank") <= n))
    base = df.groupBy(*own).agg(F.count("*").alias("taken"), F.sum(w).alias("weighted_total"), F.sum(F.when(F.col(channel).isNotNull(), F.col(w)).otherwise(0.0)).alias("_flagged"),
                                F.count_if(F.coalesce(F.col(title), F.lit("")) == "").alias("_untitled"))
    top = part("top_channel", F.col(channel), F.sum(w), 1).select("cluster", "top_channel", F.col("_v").alias("_top"))
    same = part("_template", template, F.count("*"), 1).select("cluster", F.col("_v").alias("_same"))
    titles = part("_title", F.nullif(F.col(title), F.lit("")), F.count("*"), 3).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_rank", "_title"))).alias("_t"))
    best = series.where("usable").groupBy("cluster").agg(F.max(F.struct("adjusted", F.col("period"))).alias("_peak"))
    out = base.join(best, "cluster", "left").join(first_crossings(series, line), "cluster", "left")
    out = out.join(top, "cluster", "left").join(same, "cluster", "left").join(titles, "cluster", "left")
    return out.select("cluster", "taken", "weighted_total", F.col("_peak.period").alias("peak_period"), F.col("_peak.adjusted").alias("peak_adjusted"), "first_cross",
                      F.try_divide("_flagged", "weighted_total").alias("flagged_share"), "top_channel", F.try_divide("_top", "_flagged").alias("top_channel_share"),
                      (F.col("_same") / F.col("taken")).alias("template_share"), (F.col("_untitled") / F.col("taken")).alias("titleless_share"),
                      F.array_join(F.transform("_t", lambda t: t["_title"]), " | ").alias("top_titles"))


def day_cells(df: DataFrame, by: list[str], day: str, hit: Column, w: str) -> DataFrame:
    """Rows n, hits c and weight W of each group and day: what the intervals below draw from."""
    return df.groupBy(*by, F.to_date(day).alias("day")).agg(F.count("*").alias("n"), F.count_if(hit).alias("c"), F.sum(w).cast("double").alias("W"))


def draws_of(cells: pa.Table, names: list[str], draws: int, seed: int) -> np.ndarray:
    """Weighted hits of a group in each replicate, days drawn as binomials; the generator depends on the seed and the group alone."""
    key = "|".join(str(cells.column(c)[0].as_py()) for c in names)
    rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
    cells = cells.sort_by("day")
    n, c, weight = (cells.column(x).to_numpy() for x in ("n", "c", "W"))
    return (rng.binomial(n, c / n, (draws, len(n))) * (weight / n)).sum(1)


def within_day_interval(cells: DataFrame, by: list[str], draws: int = 1000, seed: int = 1) -> DataFrame:
    """Share of each group and its 95% interval A: each day's hits are drawn anew from its own rows. A group has a row a day, so it is as
    long as the calendar."""

    def f(table: pa.Table) -> pa.Table:
        total = table.column("W").to_numpy().sum()
        n, c, weight = (table.column(x).to_numpy() for x in ("n", "c", "W"))
        low, high = np.percentile(draws_of(table, by, draws, seed) / total, [2.5, 97.5])
        first = [table.column(name)[:1] for name in by]
        return pa.Table.from_arrays([*first, [(weight * c / n).sum() / total], [low], [high]], names=[*by, "share", "low", "high"])

    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by)
    return cells.groupBy(*by).applyInArrow(f, f"{kinds}, share double, low double, high double")


def ratio_of_shares(cells: DataFrame, by: list[str], side: str, draws: int = 1000, seed: int = 1, least: int = 20) -> DataFrame:
    """Ratio of a group's share where `side` is true to that where it is false (surge against a baseline, lift against all), and its interval, both
    sides drawn within their days. No ratio without a share on the other side, no interval with fewer than `least` draws in which it isn't 0."""

    def f(table: pa.Table) -> pa.Table:
        mask = table.column(side).to_numpy(zero_copy_only=False)
        values = []
        for part in (table.filter(pa.array(mask)), table.filter(pa.array(~mask))):
            if not part.num_rows:
                values.append((0.0, np.zeros(draws)))
                continue
            n, c, weight = (part.column(x).to_numpy() for x in ("n", "c", "W"))
            values.append(((weight * c / n).sum() / weight.sum(), draws_of(part, [*by, side], draws, seed) / weight.sum()))
        (top, tops), (base, bases) = values
        ok = bases > 0
        ratio = top / base if base > 0 else None
        low, high = np.percentile(tops[ok] / bases[ok], [2.5, 97.5]) if ok.sum() >= least and ratio is not None else (None, None)
        return pa.table({**{name: table.column(name)[:1] for name in by}, "ratio": pa.array([ratio], pa.float64()), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by)
    return cells.groupBy(*by).applyInArrow(f, f"{kinds}, ratio double, low double, high double")


def label_counts(df: DataFrame, labels: Column, default: str | None = None) -> DataFrame:
    """Rows with each label, a row's repeated labels counted once, with the percent of rows; rows without a label count as default if given."""
    found = F.array_distinct(F.filter(labels, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)) if default else F.array().cast("array<string>"))
    total = df.agg(F.count("*").alias("_all"))
    counts = df.select(F.explode(found).alias("label")).groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
    return counts.select("label", "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def filled_by(df: DataFrame, group: Column, fields: dict[str, Column], least: int = 30, name: str = "(none)") -> DataFrame:
    """Percent of rows in which each field is filled, by group; rows without a group are `name`, groups under `least` rows are starred."""
    rows = df.select(F.coalesce(F.nullif(group, F.lit("")), F.lit(name)).alias("group"), *(F.when(c, 100.0).otherwise(0.0).alias(f) for f, c in fields.items()))
    out = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.avg(f).alias(f) for f in fields))
    return out.withColumn("starred", F.col("n") < least)


def major_group(codes: Column) -> Column:
    """Major group (first digit) of the first code of a list that looks like one, else null."""
    return F.nullif(F.substring(F.regexp_extract(F.coalesce(F.get(F.filter(codes, lambda c: c.rlike("[Cc]?[0-9]{4}$")), 0), F.lit("")), "([0-9]{4})$", 1), 1, 1), F.lit(""))


def year_pivot(df: DataFrame, source: str, at: str, years: list[int], but: str) -> DataFrame:
    """A10: rows by source and year, with total rows over all sources and over all but one. Rows outside the years count in `total` alone."""
    counts = df.groupBy(source).agg(*(F.count_if(F.year(at) == y).alias(f"y{y}") for y in years), F.count("*").alias("total"))
    sums = [F.sum(c).alias(c) for c in counts.columns if c != source]
    rest = counts.where(F.col(source) != but).agg(*sums).select(F.lit(f"all except {but}").alias(source), *counts.columns[1:])
    return counts.unionByName(counts.agg(*sums).select(F.lit("all").alias(source), *counts.columns[1:])).unionByName(rest)
