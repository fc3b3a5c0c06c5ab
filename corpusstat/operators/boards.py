"""Counts and shares of boards of postings: calendars, coverage of terms, candidates, mixes, carriers, matches, reviews and wording. All are one or two aggregations on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.functions import text as X


def calendar_windows(spark: SparkSession, first: str, last: str, unit: str = "month") -> DataFrame:
    """Closed windows (begin, end, days) of a year or month each from first on, the end clipped at last."""
    dates = spark.sql(f"SELECT explode(sequence(date_trunc('{unit}', to_date(:a)), to_date(:b), INTERVAL 1 {unit})) AS begin", args={"a": first, "b": last})
    begin, after = F.to_date("begin"), F.to_date(F.col("begin") + F.expr(f"INTERVAL 1 {unit}"))
    out = dates.select(begin.alias("begin"), F.least(F.date_sub(after, 1), F.to_date(F.lit(last))).alias("end"))
    return out.withColumn("days", F.datediff("end", "begin") + 1)


def implied_counts(df: DataFrame, k: str, n: str, total: str) -> DataFrame:
    """A share of n sampled rows carried over to a known total, with Wilson bounds."""
    low, high = X.wilson(F.col(k), F.col(n))
    return df.withColumns({"estimate": F.col(k) / F.col(n) * F.col(total), "low": low * F.col(total), "high": high * F.col(total)})


def term_coverage(df: DataFrame, term: str, unit: str, month: Column, w: str, least: int = 5) -> DataFrame:
    """Rows, weight and months of each term; sparse below `least` months. Each unit counts once for a term."""
    once = df.groupBy(term, unit).agg(F.first(w).alias("_w"), F.min(month).alias("_m"))
    out = once.groupBy(term).agg(F.count("*").alias("n"), F.sum("_w").alias("weighted"), F.count_distinct("_m").alias("months"))
    return out.withColumn("sparse", F.col("months") < least)


def candidate_shares(df: DataFrame, item: str, w: str, periods: dict[str, Column], known: DataFrame) -> DataFrame:
    """Share of each item within each named period, of items that aren't among the known ones."""
    sums = {name: F.sum(F.when(inside, F.col(w)).otherwise(0.0)) for name, inside in periods.items()}
    cells = df.groupBy(item).agg(*(x.alias(name) for name, x in sums.items()))
    totals = cells.agg(*(F.sum(name).alias(f"_{name}") for name in periods))
    return cells.join(known, item, "left_anti").crossJoin(F.broadcast(totals)).select(item, *((F.col(name) / F.col(f"_{name}")).alias(name) for name in periods))  # totals: one row


def rates(df: DataFrame, by: list[str], hit: Column, per: int = 10_000) -> DataFrame:
    """Hits for every `per` rows."""
    return df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")).withColumn("rate", per * F.col("hits") / F.col("n"))


def page_ranges(df: DataFrame, page: list[str], number: str, day: Column, value: str) -> DataFrame:
    """Per page the range of ids and of days, and the most frequent value (the least of equals)."""
    cells = df.groupBy(*page, value).agg(F.count("*").alias("_n"), F.min(number).alias("_a"), F.max(number).alias("_b"), F.min(day).alias("_c"), F.max(day).alias("_d"))
    top = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))))["v"]
    return cells.groupBy(*page).agg(F.min("_a").alias("min_id"), F.max("_b").alias("max_id"), F.min("_c").alias("min_day"), F.max("_d").alias("max_day"), top.alias("top_value"))


def outage(df: DataFrame, by: str, period: Column, value: str, fixed: str) -> DataFrame:
    """Share of one fixed value by period, the top value, and the last period in which the fixed one occurs at all."""
    cells = df.groupBy(by, period.alias("period"), value).agg(F.count("*").alias("n"))
    months = cells.groupBy(by, "period").agg((F.sum(F.when(F.col(value) == fixed, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"].alias("top_value"))
    return months.withColumn("last_seen", F.max(F.when(F.col("share") > 0, F.col("period"))).over(W.partitionBy(by)))


def mix(df: DataFrame, by: str, part: str, w: str, top: int) -> DataFrame:
    """The top parts of each group with their share of the placed weight, and the share of weight without a part."""
    cells = df.groupBy(by, part).agg(F.sum(w).alias("_w"))
    group = W.partitionBy(by)
    placed, unplaced = F.sum(F.when(F.col(part).isNotNull(), F.col("_w"))).over(group), F.sum(F.when(F.col(part).isNull(), F.col("_w")).otherwise(0.0)).over(group)
    cells = cells.withColumns({"share": F.col("_w") / placed, "unplaced": unplaced / F.sum("_w").over(group)}).where(F.col(part).isNotNull())
    return cells.withColumn("rank", F.row_number().over(group.orderBy(F.desc("_w"), part))).where(F.col("rank") <= top).select(by, part, "rank", "share", "unplaced")


def cross_tab(df: DataFrame, by: list[str], w: str) -> DataFrame:
    """Rows of each cell, and its share of the weight of its first key."""
    cells = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("_w"))
    return cells.withColumn("share", F.col("_w") / F.sum("_w").over(W.partitionBy(by[0]))).drop("_w")


def pattern_hits(df: DataFrame, group: str, period: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Of each named pattern, group and period the rows hit in the group and on the whole board, and both ratios."""
    flags = df.select(group, period, *(F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("long").alias(name) for name, p in patterns.items()))
    cells = flags.groupBy(group, period).agg(F.count("*").alias("_n"), *(F.sum(name).alias(name) for name in patterns))
    cells = cells.select(group, period, "_n", F.explode(F.create_map(*(x for name in patterns for x in (F.lit(name), F.col(name))))).alias("pattern", "hits"))
    board = W.partitionBy("pattern", period)
    out = cells.withColumns({"board_hits": F.sum("hits").over(board), "board_ratio": F.sum("hits").over(board) / F.sum("_n").over(board), "ratio": F.col("hits") / F.col("_n")})
    return out.select("pattern", group, period, "hits", "ratio", "board_hits", "board_ratio")


def carriers(df: DataFrame, by: list[str], items: Column, seeds: list[str], phrase: Column) -> DataFrame:
    """Rows with a seed, with two, with a phrase, and with either."""
    found = F.size(F.array_intersect(F.coalesce(items, F.array().cast("array<string>")), F.lit(seeds)))
    either = F.coalesce(phrase, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(found >= 1).alias("one"), F.count_if(found >= 2).alias("two"), F.count_if(either).alias("phrase"), F.count_if(either | (found >= 1)).alias("either"))


def flagged_groups(df: DataFrame, group: str, flag: Column, least: int, share: float) -> DataFrame:
    """Groups with enough flagged rows and a large enough share of them."""
    cells = df.groupBy(group).agg(F.count_if(flag).alias("flagged"), F.count("*").alias("n")).withColumn("share", F.col("flagged") / F.col("n"))
    return cells.where((F.col("flagged") >= least) & (F.col("share") >= share))


def match_statistics(df: DataFrame, by: list[str], score: str, exact: Column, cut: float) -> DataFrame:
    """Rows, median score, share at the cut or above, share of exact matches."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.median(score).alias("median"), F.avg((F.col(score) >= cut).cast("int")).alias("above"), F.avg(exact.cast("int")).alias("exact"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Count of each value and its fraction, rounded to 4 places."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(value, "n", F.round(F.col("n") / F.col("_all"), 4).alias("fraction"))  # one row


def review(df: DataFrame, by: list[str], first: str, second: str, truth: str) -> DataFrame:
    """Rows of a reviewed sheet, how many both readers agree on, and how many each has right; rows without truth aren't reviewed."""
    seen = df.where(F.col(truth).isNotNull())
    same = lambda a, b: F.count_if(F.col(a).eqNullSafe(F.col(b)))
    return seen.groupBy(*by).agg(F.count("*").alias("n"), same(first, second).alias("agree"), same(first, truth).alias("first_right"), same(second, truth).alias("second_right"))


def overlap(df: DataFrame, by: list[str], theirs: Column, ours: Column) -> DataFrame:
    """Of the distinct items of one list the share that the other list has too."""
    cells = df.groupBy(*by).agg(F.sum(F.size(F.array_intersect(theirs, ours))).alias("both"), F.sum(F.size(F.array_distinct(theirs))).alias("theirs"))
    return cells.withColumn("share", F.col("both") / F.col("theirs"))


def wording(df: DataFrame, by: list[str], context: Column, employer: str) -> DataFrame:
    """Rows, distinct wordings, share of the most frequent one, and distinct employers."""
    cells = df.groupBy(*by, context.alias("_c")).agg(F.count("*").alias("_n"))
    top = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("wordings"), (F.max("_n") / F.sum("_n")).alias("top_share"))
    return top.join(df.groupBy(*by).agg(F.count_distinct(employer).alias("employers")), by)


def employers_by_period(df: DataFrame, employer: str, period: str, periods: list[str], top: int) -> DataFrame:
    """A row for each of the top employers, a column for each period."""
    cells = df.groupBy(employer, period).agg(F.count("*").alias("_n"))
    wide = cells.groupBy(employer).agg(F.sum("_n").alias("total"), *(F.sum(F.when(F.col(period) == p, F.col("_n")).otherwise(0)).alias(p) for p in periods))
    return wide.orderBy(F.desc("total"), employer).limit(top)


def stemmed(counts: DataFrame, word: str, stem: str, n: str, factor: float = 1.5) -> DataFrame:
    """Whether a word's index seems stemmed: its stem has more than `factor` times the larger of its own count and 1."""
    stems = counts.groupBy(F.col(word).alias("_w")).agg(F.max(n).alias("_s"))
    found = counts.join(stems, F.col(stem) == F.col("_w"), "left")
    return found.select(word, stem, n, F.coalesce(F.col("_s") > factor * F.greatest(F.col(n), F.lit(1)), F.lit(False)).alias("stemmed"))


def matcher_precision(df: DataFrame, method: str, right: str) -> DataFrame:
    """Precision of each method over the rows with a verdict, with Wilson bounds."""
    cells = df.where(F.col(right).isNotNull()).groupBy(method).agg(F.count("*").alias("n"), F.count_if(right).alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return cells.select(method, "n", (F.col("k") / F.col("n")).alias("precision"), low.alias("low"), high.alias("high"))


def decision(value: Column, low: Column, limit: float) -> Column:
    """Accepted; borderline, where only the lower bound is under the limit; not accepted. Null where there is no value."""
    return F.when(value.isNull(), F.lit(None)).when(value < limit, "not accepted").when(low < limit, "borderline").otherwise("accepted")


def weekly_outliers(weeks: DataFrame, period: str, week: str, value: str, top: int) -> DataFrame:
    """The weeks furthest from the mean of their period."""
    gap = F.col(value) - F.avg(value).over(W.partitionBy(period))
    ranked = weeks.withColumn("gap", gap).withColumn("rank", F.row_number().over(W.partitionBy(period).orderBy(F.desc(F.round(F.abs("gap"), 9)), week)))
    return ranked.where(F.col("rank") <= top).select(period, week, "gap", "rank")


def best_rules(df: DataFrame, keyword: str, rule: str, returned: Column, predicted: Column) -> DataFrame:
    """Of each keyword the rule whose predicted ids fit the returned ones best by F1 (the first by name of equals)."""
    both, n, m = F.size(F.array_intersect(returned, predicted)), F.size(F.array_distinct(returned)), F.size(F.array_distinct(predicted))
    scored = df.withColumn("f1", F.when(n + m > 0, 2 * both / (n + m)).otherwise(0.0))
    best = scored.groupBy(keyword).agg(F.min(F.struct((-F.col("f1")).alias("f"), F.col(rule).alias("r"))).alias("b"))
    return best.select(keyword, F.col("b.r").alias(rule), (-F.col("b.f")).alias("f1"))
