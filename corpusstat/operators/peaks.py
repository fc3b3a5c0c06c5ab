"""A peak looked into: weeks, the units behind it, what is left without the largest, and one week's wordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weekly(df: DataFrame, day: str, w: str, hits: dict[str, Column], windows: list[tuple[str, str]]) -> DataFrame:
    """Per window (first and last day) and week (its Monday) the rows, their weight, and each hit's weighted share. Windows are a short list and may overlap; weeks are cut at a window's ends; null days are in none, and a null hit is none."""
    spans = F.array(*(F.struct(F.lit(a).cast("date").alias("begin"), F.lit(b).cast("date").alias("end")) for a, b in windows))
    inside = df.withColumn("_span", F.explode(F.filter(spans, lambda s: F.col(day).between(s["begin"], s["end"]))))
    share = lambda c: F.try_divide(F.sum(F.when(c, F.col(w)).otherwise(0.0)), F.sum(w))
    return inside.groupBy(F.col("_span.begin").alias("begin"), F.date_trunc("week", day).cast("date").alias("week")).agg(F.count("*").alias("taken"), F.sum(w).alias("population"), *(share(c).alias(n) for n, c in hits.items()))


def employers_behind(df: DataFrame, period: Column, employer: str, w: str, hit: Column, top: int = 15) -> DataFrame:
    """Per period and of its employers with hits the `top` by weight of hits (ties by name): hits taken, their share of the period's hits, the employer's share of all rows, and the period's figures:
    its hits' share of all, its number of employers with hits, and what the first 1 and 5 of them hold. A null employer is one. Sums are by employer before anything is ranked."""
    cells = df.select(period.alias("period"), F.coalesce(employer, F.lit("")).alias("employer"), F.col(w).alias("w"), F.coalesce(hit, F.lit(False)).alias("hit")).where("period is not null")
    cells = cells.groupBy("period", "employer").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("hits"), F.count_if("hit").alias("taken"))
    whole, order = W.partitionBy("period"), W.partitionBy("period").orderBy(F.desc("hits"), "employer")
    totals = cells.groupBy("period").agg(F.sum("all").alias("_all"), F.sum("hits").alias("_hits"), F.count_if(F.col("taken") > 0).alias("employers"))
    ranked = cells.where("taken > 0").withColumn("rank", F.row_number().over(order)).join(totals, "period")
    first = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hits")).otherwise(0.0)).over(whole) / F.col("_hits")
    out = ranked.withColumns({"top1": first(1), "top5": first(5)}).where(F.col("rank") <= top)
    return out.select("period", "rank", "employer", "taken", (F.col("hits") / F.col("_hits")).alias("share_of_hits"), (F.col("all") / F.col("_all")).alias("share_of_all"), (F.col("_hits") / F.col("_all")).alias("hit_share"), "employers", "top1", "top5")


def without_largest(df: DataFrame, period: Column, employer: str, w: str, hit: Column, ks: tuple[int, ...] = (0, 1, 3, 5)) -> DataFrame:
    """Per period the hits' share of all rows when the k employers with most weight of hits are left out (ties by name), for each k; null where nothing is left."""
    cells = df.select(period.alias("period"), F.coalesce(employer, F.lit("")).alias("employer"), F.col(w).alias("w"), F.coalesce(hit, F.lit(False)).alias("hit")).where("period is not null")
    cells = cells.groupBy("period", "employer").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("hits"))
    rank = F.when(F.col("hits") > 0, F.row_number().over(W.partitionBy("period").orderBy(F.desc("hits"), "employer"))).otherwise(F.lit(max(ks) + 1))
    kept = cells.withColumn("rank", rank).groupBy("period").agg(*(f(F.col(c), k).alias(f"{c}{k}") for k in ks for c, f in (("all", lambda x, k: F.sum(F.when(F.col("rank") > k, x))), ("hits", lambda x, k: F.sum(F.when(F.col("rank") > k, x))))))
    return kept.select("period", F.explode(F.array(*(F.struct(F.lit(k).alias("left_out"), F.try_divide(f"hits{k}", f"all{k}").alias("share")) for k in ks))).alias("s")).select("period", "s.*")


def week_inspection(df: DataFrame, day: str, begin: str, end: str, channel: str, title: Column, opening: Column, top: int = 12) -> DataFrame:
    """PB18: of the rows from begin to end, copies not removed: (what, name, n, share) with the totals (days, rows, flagged: share of rows), the channels, the `top` titles and openings of flagged rows (most first, then by
    name; shares are of the flagged rows, so the first opening's says what the largest template holds). A null channel is unflagged; null titles and openings are ''."""
    rows = df.where(F.col(day).between(F.lit(begin).cast("date"), F.lit(end).cast("date"))).select(F.col(day).alias("day"), F.col(channel).alias("channel"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(opening, F.lit("")).alias("opening"))
    sums = rows.agg(F.count_distinct("day").alias("days"), F.count("*").alias("rows"), F.count("channel").alias("flagged"))
    total = lambda name, share: F.struct(F.lit("total").alias("what"), F.lit(name).alias("name"), F.col(name).alias("n"), share.cast("double").alias("share"))
    one = sums.select(F.explode(F.array(total("days", F.lit(None)), total("rows", F.lit(None)), total("flagged", F.try_divide("flagged", "rows")))).alias("s")).select("s.*")
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("name")) for c in ("channel", "title", "opening")))).alias("p")
    counts = rows.where("channel is not null").select(parts).select("p.*").groupBy("what", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("what").orderBy(F.desc("n"), "name"))
    best = counts.withColumn("rank", rank).where((F.col("what") == "channel") | (F.col("rank") <= top)).join(F.broadcast(sums))  # one row
    return one.union(best.select("what", "name", "n", F.try_divide("n", "flagged")))


def region_table(df: DataFrame, cluster: str, region: str, w: str, clusters: list, top: int = 3) -> DataFrame:
    """Per chosen cluster its rows, those with a region, the weighted share without one, and for each of its `top` regions by weight (ties by name) the share of what has a region. A cluster without a region has one row with a null rank;
    one without rows has none."""
    rows = df.where(F.col(cluster).isin(clusters)).select(F.col(cluster).alias("cluster"), F.nullif(F.col(region), F.lit("")).alias("region"), F.col(w).alias("w"))
    cells = rows.groupBy("cluster", "region").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    placed = F.col("region").isNotNull()
    about = cells.groupBy("cluster").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(placed, F.col("n"))), F.lit(0)).alias("placed"), F.try_divide(F.sum(F.when(~placed, F.col("w")).otherwise(0.0)), F.sum("w")).alias("unplaced"), F.sum(F.when(placed, F.col("w"))).alias("_w"))
    ranked = cells.where(placed).withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("w"), "region"))).where(F.col("rank") <= top)
    return about.join(ranked.select("cluster", "rank", "region", F.col("w").alias("_own")), "cluster", "left").select("cluster", "rows", "placed", "unplaced", "rank", "region", F.try_divide("_own", "_w").alias("share"))


def weak_clusters(lifts: DataFrame, first: str, percent: float = 10.0) -> DataFrame:
    """Per input of lifts (input, cluster, size, lift) its clusters, the quartiles of their lift, the cut-off (the percentile of the lifts of the input `first`, one bar for all inputs), the clusters below it and the share of the input's
    rows in them. Null lifts are left out. No bar where `first` has no clusters: then none is below. Rows are clusters, so there are few."""
    known = lifts.where(F.col("lift").isNotNull())
    bar = known.where(F.col("input") == first).agg(F.percentile("lift", percent / 100).alias("cutoff"))
    weak = F.coalesce(F.col("lift") < F.col("cutoff"), F.lit(False))
    out = known.join(F.broadcast(bar)).groupBy("input", "cutoff").agg(F.count("*").alias("clusters"), F.percentile("lift", [0.25, 0.5, 0.75]).alias("_q"), F.count_if(weak).alias("weak"), F.try_divide(F.sum(F.when(weak, F.col("size")).otherwise(0)), F.sum("size")).alias("rows_in_weak"))  # one row
    return out.select("input", "clusters", *(F.get("_q", i).alias(c) for i, c in enumerate(("q1", "median", "q3"))), "cutoff", "weak", "rows_in_weak")
