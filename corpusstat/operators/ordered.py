"""Ordered analytics, weights, sampling plans and sensitivity. Windows run over aggregates (days, periods, distinct values), never over raw rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def joint_dips(series: DataFrame, unit: str, period: str, low: str, high: str, line: float, least: int = 3, part: float = 0.3) -> DataFrame:
    """Per period the units clearly above the line before, those of them wholly below it now, and whether that is many at once."""
    past = W.partitionBy(unit).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    marked = series.withColumn("_was", F.coalesce(F.max(low).over(past) >= line, F.lit(False)))
    out = marked.groupBy(period).agg(F.count_if("_was").alias("above_before"), F.count_if(F.col("_was") & (F.col(high) < line)).alias("dips"))
    return out.withColumn("joint", (F.col("dips") >= least) & (F.col("dips") >= part * F.col("above_before")))


def jump_candidates(days: DataFrame, unit: str, day: str, value: str, span: int) -> DataFrame:
    """Ratio of the mean of the next `span` days to that of the `span` days before, where both stretches are whole and lie close
    together in the calendar (at most 2 * span + 6 days from first to last)."""
    w = W.partitionBy(unit).orderBy(day)
    before, after = w.rowsBetween(-span, -1), w.rowsBetween(0, span - 1)
    wide = days.withColumns({"before": F.avg(value).over(before), "after": F.avg(value).over(after), "_n": F.count(value).over(before) + F.count(value).over(after), "_days": F.datediff(F.max(day).over(after), F.min(day).over(before))})
    whole = wide.where((F.col("_n") == 2 * span) & (F.col("_days") <= 2 * span + 6) & (F.col("before") > 0))
    return whole.select(unit, day, "before", "after", (F.col("after") / F.col("before")).alias("ratio"))


def volume_thirds(days: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """The n // 3 days of a group with the least volume are low, the n // 3 with the most high; ties by day."""
    n = F.count("*").over(W.partitionBy(*by))
    third = F.floor(n / 3)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(value, day))
    return days.select(*by, day, value, F.when(rank <= third, "low").when(rank > n - third, "high").otherwise("middle").alias("third"))


def transitions(series: DataFrame, unit: str, period: str, value: str) -> DataFrame:
    """Each period's value, the one before and their difference."""
    before = F.lag(value).over(W.partitionBy(unit).orderBy(period))
    return series.select(unit, period, value, before.alias("before"), (F.col(value) - before).alias("change"))


def clock_breaks(df: DataFrame, key: str, page: str, at: str, width: int = 10_000) -> DataFrame:
    """Rows dated before their neighbour with the next smaller id, on another page. Ids are cut into ranges of `width`, so that
    no task orders all rows; a range's first row meets the last row of the range before, from a table of one row a range."""
    rows = df.select(key, page, at, F.floor(F.col(key) / width).alias("_range"))
    lasts = rows.groupBy("_range").agg(F.max_by(F.struct(page, at), key).alias("_last"), F.min(key).alias("_first"))
    heads = lasts.select(F.lag("_last").over(W.orderBy("_range")).alias("_prev"), F.col("_first").alias(key))
    w = W.partitionBy("_range").orderBy(key)
    near = rows.withColumn("_near", F.lag(F.struct(page, at)).over(w)).join(heads, key, "left").withColumn("_near", F.coalesce("_near", "_prev"))
    return near.where((F.col(f"_near.{page}") != F.col(page)) & (F.col(at) < F.col(f"_near.{at}"))).select(key, F.col(at), F.col(f"_near.{at}").alias("before"))


def share_below(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Share of a group's rows strictly below each row's value, by running sums over the distinct values."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(by, value, (below / F.sum("_n").over(W.partitionBy(by))).alias("below"))
    return df.select(key, by, value).join(places, [by, value])


def knee(df: DataFrame, count: str) -> DataFrame:
    """Rank and count at the knee of the rank-frequency curve (largest gap under the chord, linear axes; null under 5 items).
    Among items with one count the first is furthest from the chord, so a histogram of counts, with one row a count, is enough."""
    blocks = df.groupBy(F.col(count).alias("c")).agg(F.count("*").alias("_n"))
    rank = 1 + F.coalesce(F.sum("_n").over(W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.select("c", rank.alias("rank"))
    ends = blocks.agg(F.sum("_n").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    gap = 1 - (F.col("rank") - 1) / (F.col("n") - 1) - F.try_divide(F.col("c") - F.col("least"), F.col("most") - F.col("least"))
    best = ranked.join(F.broadcast(ends)).where("n >= 5").agg(F.max_by(F.struct("rank", "c"), F.struct(F.round(gap, 12), -F.col("rank"))).alias("k"))
    return best.select("k.rank", F.col("k.c").alias("count"))


def grid(df: DataFrame, pages: str, k: int) -> DataFrame:
    """K evenly spaced pages of 1..pages, halves to even, distinct."""
    n = F.col(pages)
    size = F.least(F.lit(k).cast("bigint"), n.cast("bigint"))
    spots = F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), lambda j: F.greatest(F.lit(1).cast("bigint"), F.least(n.cast("bigint"), F.bround((j + 0.5) * n / size).cast("bigint"))))
    return df.where(n > 0).withColumn("page", F.explode(F.array_distinct(spots)))


def allocate(sizes: dict[str, int], n: int) -> dict[str, int]:
    """N places dealt equally over strata, none above its size; what a small stratum leaves goes to the others. A table of strata."""
    given = dict.fromkeys(sizes, 0)
    while (left := n - sum(given.values())) > 0 and (room := [s for s in sizes if given[s] < sizes[s]]):
        each = max(1, left // len(room))
        for s in room:
            given[s] += min(each, sizes[s] - given[s], n - sum(given.values()))
    return given


def round_robin(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """N rows, taken from the groups in turn; a group's rows in the order of the key."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(key))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def rescaled(df: DataFrame, w: str, mode: str, percent: float = 95.0) -> DataFrame:
    """Weights as log1p, or capped at a percentile, brought back to their old total. Weights are totals of a day over what was
    taken, so there are no more distinct values than days, and they are counted by value before the percentile."""
    if mode == "cap":
        values = df.groupBy(w).agg(F.count("*").alias("_n"))
        limit = values.agg(F.percentile(w, percent / 100, F.col("_n")).alias("_cap"))
        moved = df.join(F.broadcast(limit)).withColumn("_new", F.least(F.col(w), F.col("_cap"))).drop("_cap")
    else:
        moved = df.withColumn("_new", F.log1p(w))
    factor = moved.agg((F.sum(w) / F.sum("_new")).alias("_factor"))
    return moved.join(F.broadcast(factor)).withColumn(w, F.col("_new") * F.col("_factor")).drop("_new", "_factor")


def daily_effective(df: DataFrame, day: Column, unit: str) -> DataFrame:
    """Effective number of employers of a day, and its 10th, 50th and 90th percentile over days."""
    counts = df.where(F.col(unit).isNotNull()).groupBy(day.alias("day"), unit).agg(F.count("*").alias("n"))
    effective = counts.groupBy("day").agg((F.pow(F.sum("n").cast("double"), 2) / F.sum(F.col("n").cast("double") * F.col("n"))).alias("e"))
    q = effective.agg(F.count("*").alias("days"), F.percentile("e", F.array(*(F.lit(x) for x in (0.1, 0.5, 0.9)))).alias("q"))
    return q.select("days", *(F.get("q", i).alias(name) for i, name in enumerate(("p10", "p50", "p90"))))


def contributions(df: DataFrame, unit: str, hit: Column, after: Column, w: str) -> DataFrame:
    """What each employer adds to the change of a share from before to after; the rows sum to the whole change. One aggregate."""
    part = lambda cond: F.sum(F.when(cond, F.col(w)).otherwise(0.0))
    cells = df.withColumns({"_hit": hit, "_after": after}).groupBy(unit).agg(part(F.col("_hit") & F.col("_after")).alias("ha"), part(F.col("_hit") & ~F.col("_after")).alias("hb"), part(F.col("_after")).alias("a"), part(~F.col("_after")).alias("b"))
    totals = cells.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return cells.join(F.broadcast(totals)).select(unit, (F.try_divide("ha", "ta") - F.try_divide("hb", "tb")).alias("contribution"))


def leave_out(df: DataFrame, unit: str, hit: Column, w: str, ks: tuple[int, ...] = (0, 1, 3, 5)) -> DataFrame:
    """The share of hits without the k employers that have the most weight of hits; ties by name. max(ks) names are broadcast."""
    cells = df.withColumn("_hit", hit).groupBy(unit).agg(F.sum(w).alias("x"), F.sum(F.when(F.col("_hit"), F.col(w)).otherwise(0.0)).alias("h"))
    top = cells.orderBy(F.desc("h"), unit).limit(max(ks)).select(unit, "h").withColumn("rank", F.row_number().over(W.orderBy(F.desc("h"), unit))).drop("h")
    ranked = cells.join(F.broadcast(top), unit, "left").withColumn("rank", F.coalesce("rank", F.lit(max(ks) + 1)))
    kept = ranked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") > F.col("k"))
    return kept.groupBy("k").agg((F.sum("h") / F.sum("x")).alias("share"))


def weighted_median(df: DataFrame, by: str, value: str, size: str) -> DataFrame:
    """The first value, in order, at which the cumulative share of sizes reaches a half."""
    sums = df.groupBy(by, value).agg(F.sum(size).alias("_s"))
    upto = F.sum("_s").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return sums.withColumn("_half", 2 * upto >= F.sum("_s").over(W.partitionBy(by))).where("_half").groupBy(by).agg(F.min(value).alias("median"))


def collapse_rare(df: DataFrame, value: str, k: int = 40) -> DataFrame:
    """Values beyond the k most frequent become '(other)'; ties by value. k values are broadcast."""
    top = df.groupBy(value).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), value).limit(k).select(F.col(value).alias("_kept"))
    return df.join(F.broadcast(top), F.col(value) == F.col("_kept"), "left").withColumn(value, F.coalesce("_kept", F.lit("(other)"))).drop("_kept")


def count_check(days: DataFrame, months: DataFrame, month: str, n: str, limit: float = 0.02) -> DataFrame:
    """Day totals of a month against the month's own total, marked where they differ by more than the limit."""
    sums = days.groupBy(month).agg(F.sum(n).alias("days_total"))
    out = sums.join(months.select(month, F.col(n).alias("month_total")), month)
    return out.withColumn("differs", F.abs(F.col("days_total") - F.col("month_total")) > limit * F.col("month_total"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from counts of label pairs."""
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    one = cells.agg(pairs("n").alias("both"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("rows"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("cols"))
    by_chance = F.col("rows") * F.col("cols") / (F.col("all").cast("double") * (F.col("all") - 1) / 2)
    return one.join(F.broadcast(rows)).join(F.broadcast(cols)).select(F.try_divide(F.col("both") - by_chance, (F.col("rows") + F.col("cols")) / 2 - by_chance).alias("ari"))


def cumulative(cells: DataFrame, value: str, sums: list[str], parts: int = 64) -> DataFrame:
    """cells (one row a value) with running sums up to each value. Values are cut into ranges at approximate quantiles; each range's own running sums get
    what all ranges before it hold, from a table of one row a range. So no task orders all values."""
    bounds = sorted(set(cells.stat.approxQuantile(value, [k / parts for k in range(1, parts)], 0.005)))
    place = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < F.col(value))) if bounds else F.lit(0)
    rows = cells.withColumn("_range", place)
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums))
    inside = W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(totals), "_range")  # at most `parts` rows
    return out.withColumns({f"upto_{c}": F.sum(c).over(inside) + F.col(f"_t_{c}") for c in sums}).drop("_range", *(f"_t_{c}" for c in sums))


def percentile_of(df: DataFrame, value: str, q: float, rule: str = "linear") -> DataFrame:
    """A percentile by one of three rules: linear between neighbours; nearest, the value at place round(q * (n - 1)), half to even; index, the value at
    place floor(q * n), at most the last. Over counts by value, with no task that orders all rows."""
    cells = cumulative(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), value, ["_n"])
    n = cells.agg(F.sum("_n").alias("_all"))
    spot = {"linear": F.lit(q) * (F.col("_all") - 1), "nearest": F.bround(F.lit(q) * (F.col("_all") - 1)), "index": F.least(F.floor(F.lit(q) * F.col("_all")), F.col("_all") - 1)}[rule]
    rows = cells.join(F.broadcast(n)).withColumn("_at", spot.cast("double"))  # one row
    low = F.min(F.when(F.col("upto__n") > F.floor("_at"), F.col(value)))
    high = F.min(F.when(F.col("upto__n") > F.ceil("_at"), F.col(value)))
    part = F.max(F.col("_at") - F.floor("_at"))
    return rows.agg((low + (high - low) * part).alias("percentile"))
