"""How postings meet tags, labels, keys and samples, and the filters that a report starts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The channels a tag may have, and the ranks of its intensity.
CHANNELS = ["reshoring", "defense", "critical materials", "energy security", "trade compliance", "diversification"]
RANKS = {"low": 0, "medium": 1, "high": 2}


def with_tags(df: DataFrame, tags: DataFrame, key: str, default: dict) -> DataFrame:
    """All rows of df with the columns of tags (unique by key); the defaults stand where a row has no tag or its value is null."""
    out = df.join(tags.select(key, *default), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def restrict(df: DataFrame, keys: DataFrame, key: str, done: DataFrame | None = None) -> DataFrame:
    """Rows whose key is in keys and not in done. Neither side needs unique keys."""
    out = df.join(keys.select(key).distinct(), key, "left_semi")
    return out.join(done.select(key), key, "left_anti") if done is not None else out


def tagged_export(df: DataFrame, tags: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """J1, SK2: rows with a tag, the fields asked for (missing ones null), in a global order by ranges."""
    out = df.join(tags, key)
    out = out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in fields))
    return out.orderBy(*order)


def scoring(key: DataFrame, sheet: DataFrame, tags: DataFrame, by: str) -> DataFrame:
    """Rows of the key that an annotator filled in, with the model's channel: 'none' without a tag, 'invalid' where the tagger failed."""
    out = key.join(sheet, by).join(tags, by, "left")
    said = F.when(F.col("ok").isNull(), "none").when(~F.col("ok"), "invalid").otherwise(F.coalesce("channel", F.lit("none")))
    return out.where(F.trim("truth") != "").select(by, "stratum", "weight", F.lower(F.trim("truth")).alias("truth"), said.alias("said"))


def origins(labels: DataFrame, base: DataFrame, key: str, label: str) -> DataFrame:
    """How many members each cluster has from each cluster of a baseline, and their part of the cluster's members in both."""
    old = base.select(key, F.col(label).alias("base"))
    counts = labels.join(old, key).groupBy(label, "base").agg(F.count("*").alias("n"))
    return counts.withColumn("part", F.col("n") / F.sum("n").over(W.partitionBy(label)))


def known_counts(samples: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The samples with the count of their keys, or where it is absent the known constant that the sample brings along."""
    out = samples.join(counts.select(*keys, F.col("n").alias("_n")), keys, "left")
    return out.withColumn("total", F.coalesce("_n", "known")).drop("_n")


def in_both(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Ids with both labels, and whether each is clustered (0 or more)."""
    out = a.select(key, F.col(label).alias("a")).join(b.select(key, F.col(label).alias("b")), key)
    return out.withColumn("both", (F.col("a") >= 0) & (F.col("b") >= 0))


def share_in_both(pairs: DataFrame) -> DataFrame:
    """Ids with both labels, and the share of them clustered in both, in either, and equal where clustered in both."""
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    equal = F.avg(F.when(F.col("both"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)))
    either = (F.col("a") >= 0) | (F.col("b") >= 0)
    return pairs.agg(F.count("*").alias("n"), one(F.col("both")).alias("both"), one(either).alias("either"), equal.alias("equal"))


def flagged(tags: DataFrame, least: str = "low", default: str | None = "low", channels: list[str] = CHANNELS) -> DataFrame:
    """tags that are ok, in one of the channels and of at least an intensity. A missing intensity counts as default, or with None is out."""
    ranks = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    name = F.coalesce(F.nullif("intensity", F.lit("")), F.lit(default)) if default else F.col("intensity")
    rank = F.coalesce(F.try_element_at(ranks, name), F.lit(-1 if default is None else 0))
    return tags.where(F.coalesce("ok", F.lit(False)) & F.col("channel").isin(channels) & (rank >= RANKS[least]))


def between(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """days from first to last, both included."""
    return df.where(F.to_date(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def usable(df: DataFrame, period: str, day: str, least: int) -> DataFrame:
    """rows of the periods with at least so many sampled days. The days are counted without moving rows."""
    days = df.select(period, day).distinct().groupBy(period).agg(F.count("*").alias("_days")).where(F.col("_days") >= least)
    return df.join(days.select(period), period, "left_semi")


def eligible(summary: DataFrame, most_template: float = 0.5, most_titleless: float = 0.5) -> DataFrame:
    """clusters (0 or more) that crossed the line, whose text isn't one template and whose rows have titles."""
    good = (F.col("cluster") >= 0) & F.col("first_cross").isNotNull()
    good &= (F.col("template_share") < most_template) & (F.col("titleless_share") <= most_titleless)
    return summary.withColumn("eligible", good)


def presence_lines(series: DataFrame, unit: str, value: str, lines: list[float]) -> DataFrame:
    """for each candidate line, how many units reach it in their best period."""
    peaks = series.groupBy(unit).agg(F.max(value).alias("peak"))
    line = F.explode(F.array(*(F.lit(float(x)) for x in lines))).alias("line")
    return peaks.select("peak", line).groupBy("line").agg(F.count_if(F.col("peak") >= F.col("line")).alias("reach"), F.count("*").alias("units"))


def frequent_items_out(df: DataFrame, unit: str, items: Column, most: float) -> DataFrame:
    """rows (unit, item) without the items that are in more than this share of the units; each unit counts an item once."""
    rows = df.select(unit, F.explode(F.array_distinct(items)).alias("item"))
    total = df.agg(F.count_distinct(unit).alias("_units"))
    counts = rows.distinct().groupBy("item").agg(F.count("*").alias("_n")).join(F.broadcast(total))  # one row
    return rows.distinct().join(counts.where(F.col("_n") <= most * F.col("_units")).select("item"), "item", "left_semi")


def overlaps_seed(term: Column, seeds: list[str]) -> Column:
    """whether a term holds a seed as whole words, is held by one, or shares its first or last word with a seed's. Seeds are a short list."""
    padded = F.concat(F.lit(" "), F.lower(term), F.lit(" "))
    words = F.split(F.trim(F.lower(term)), " +")
    edges = sorted({w for s in seeds for w in (s.lower().split()[0], s.lower().split()[-1])})
    held = [padded.contains(f" {s.lower()} ") | F.lit(f" {s.lower()} ").contains(padded) for s in seeds]
    found = F.get(words, F.lit(0)).isin(edges) | F.element_at(words, -1).isin(edges)
    for h in held:
        found |= h
    return found


def enough(estimates: DataFrame, group: str, value: str, least: float = 100.0) -> DataFrame:
    """groups whose estimate is at least so large in every month before and after, with the smallest one."""
    worst = estimates.groupBy(group).agg(F.min(value).alias("smallest"), F.count_if(F.col(value).isNull()).alias("unknown"))
    return worst.withColumn("ok", (F.col("smallest") >= least) & (F.col("unknown") == 0))


def month_gates(df: DataFrame, source: str, at: str, first: str, last: str) -> DataFrame:
    """First and last month, rows with and without a date of each source, and whether the months cover a span."""
    month = F.date_format(at, "yyyy-MM")
    out = df.groupBy(source).agg(F.min(month).alias("first"), F.max(month).alias("last"), F.count(at).alias("dated"), F.count("*").alias("n"))
    covers = (F.col("first") <= first) & (F.col("last") >= last)
    return out.withColumns({"undated": F.col("n") - F.col("dated"), "covers": F.coalesce(covers, F.lit(False))})


def two_back(rows: DataFrame, spec, page: str, name: str) -> DataFrame:
    """rows (_key, s, ...) with the nearest s before each in the order of spec, and the nearest one of another page than that one's."""
    past, upto = spec.rowsBetween(W.unboundedPreceding, -1), spec.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.last("s", ignorenulls=True).over(past))
    changed = F.col("s").isNotNull() & (F.col(f"{name}.{page}") != F.col(f"s.{page}"))  # a run of one page begins here
    return rows.withColumn(f"{name}2", F.last(F.when(changed, F.col(name)), ignorenulls=True).over(upto))


def nearest_dated(df: DataFrame, key: str, page: str, at: str, width: int = 10_000) -> DataFrame:
    """For each undated row the date of the dated row with the nearest id on another page (of two equally near the smaller id). Ids are
    cut into ranges of `width`. A range's windows see its own rows and the nearest dated ones of the ranges around it, which come from
    a table of at most two rows a range (the outermost ones of two pages); only that table is ordered as a whole."""
    rows = df.select(F.col(key).alias("_key"), F.col(page).alias("_page"), at, F.floor(F.col(key) / width).alias("_range"))
    rows = rows.withColumn("s", F.when(F.col(at).isNotNull(), F.struct(F.col("_key").alias("k"), F.col(at).alias("at"), F.col("_page").alias("p"))))
    dated, starts = rows.where("s is not null"), rows.groupBy("_range").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    extra = []
    for name, pick, order, edge in (("before", F.max, F.asc, "_low"), ("after", F.min, F.desc, "_high")):
        ends = dated.groupBy("_range", "_page").agg(pick("s").alias("s"))
        inner = F.row_number().over(W.partitionBy("_range").orderBy((F.desc if name == "before" else F.asc)("s.k")))
        ends = ends.withColumn("_n", inner).where("_n <= 2").select("_range", F.col("s.k").alias("_key"), "s")
        marks = starts.select("_range", F.col(edge).alias("_key"), F.lit(None).cast(rows.schema["s"].dataType).alias("s"))
        # a range's mark stands before its own rows, from where the search comes
        spec = W.orderBy(order("_range"), F.col("s").isNotNull(), order("_key"))
        found = two_back(marks.union(ends), spec, "p", name).where("s is null")
        extra += [found.select("_range", F.col(c).alias("s")).where("s is not null") for c in (name, f"{name}2")]
    pool = dated.select("_range", "s")
    for e in extra:
        pool = pool.union(e)
    asked = rows.where("s is null").select("_range", "_key", "s", "_page")
    both = pool.select("_range", F.col("s.k").alias("_key"), "s", F.lit(None).cast(rows.schema["_page"].dataType).alias("_page")).union(asked)
    for name, order in (("before", F.asc), ("after", F.desc)):
        both = two_back(both, W.partitionBy("_range").orderBy(order("_key")), "p", name)
    elsewhere = lambda c: F.when(~F.col(f"{c}.p").eqNullSafe(F.col("_page")), F.col(c))
    out = both.where("s is null").withColumns({"l": F.coalesce(elsewhere("before"), elsewhere("before2")), "r": F.coalesce(elsewhere("after"), elsewhere("after2"))})
    left = F.col("r").isNull() | (F.col("_key") - F.col("l.k") <= F.col("r.k") - F.col("_key"))
    near = F.when(F.col("l").isNull(), F.col("r")).when(left, F.col("l")).otherwise(F.col("r"))
    return out.withColumn("near", near).select(F.col("_key").alias(key), F.col("near.k").alias("near_id"), F.col("near.at").alias("near_at"))
