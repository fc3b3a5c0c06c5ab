"""Corpus construction, de-duplication, completeness and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.functions.text import missing, norm_words
from corpusstat.operators.resample import uniform


def weighted_corpus(df: DataFrame, text: str, day: str, total: str, order: list[str], keep_empty: bool = False) -> DataFrame:
    """DD1: of rows with the same normalised text the first by day and order stays, one of them where rows repeat that place too (all empty texts are the
    same unless keep_empty); w = the row's own total / rows kept that day. One aggregate reads each text once, and Spark takes minima
    before the shuffle, so a frequent text is no hot group."""
    norm = norm_words(F.coalesce(F.col(text), F.lit("")))
    key = F.md5(norm)
    if keep_empty:
        key = F.when(norm == "", F.concat(F.lit("#"), F.concat_ws("#", day, *order))).otherwise(key)
    place = F.struct(F.col(day), *(F.col(c) for c in order))
    kept = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct("*"), place).alias("_row")).select("_row.*")
    taken = kept.groupBy(day).agg(F.count("*").alias("_taken"))
    return kept.join(taken, day).withColumn("w", F.col(total) / F.col("_taken")).drop("_taken")


def posting_keys(id_: Column, source_id: Column, title: Column, organization: Column, location: Column, date: Column, description: Column, least: int = 80) -> dict[str, Column]:
    """DD2 to DD4: the keys that tell repeated postings: by id, by title, employer, place and day (null without a title), and by the first 300 characters of
    the normalised description (null under `least` characters)."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    fields = F.concat_ws("|", *(norm_words(blank(c)) for c in (title, organization, location)), F.substring(blank(date.cast("string")), 1, 10))
    body = norm_words(blank(description))
    return {
        "id": F.coalesce(F.nullif(id_.cast("string"), F.lit("")), source_id.cast("string")),
        "fields": F.when(norm_words(blank(title)) != "", fields),
        "text": F.when(F.length(body) >= least, F.md5(F.substring(body, 1, 300))),
    }


def repeated_share(df: DataFrame, group: str, value: Column) -> DataFrame:
    """DD7: 1 - distinct / n of each group's known values."""
    counts = df.where(value.isNotNull()).groupBy(group, value.alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.sum("_n").alias("n"), (1 - F.count("*") / F.sum("_n")).alias("repeated"))


def ambiguous_names(df: DataFrame, name: str, code: str) -> DataFrame:
    """Names with more than one code, the codes' number and rows, and the share of the most frequent one."""
    counts = df.where(F.col(code).isNotNull()).groupBy(name, code).agg(F.count("*").alias("_n"))
    out = counts.groupBy(name).agg(F.count("*").alias("codes"), F.sum("_n").alias("n"), (F.max("_n") / F.sum("_n")).alias("top_share"))
    return out.where("codes > 1")


def repeats(df: DataFrame, key: Column, source: str) -> DataFrame:
    """DD5: repeats of keys within each source."""
    counts = df.select(F.col(source), key.alias("k")).where("k is not null").groupBy(source, "k").agg(F.count("*").alias("n"))
    return counts.groupBy(source).agg(F.sum(F.col("n") - 1).alias("repeats"), F.count("*").alias("keys"))


def shared_keys(df: DataFrame, key: Column, source: str) -> DataFrame:
    """Keys that each pair of sources shares. A key's sources are a set, so a frequent key makes no more pairs than there are sources."""
    sets = df.select(F.col(source), key.alias("k")).where("k is not null").groupBy("k").agg(F.sort_array(F.collect_set(source)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def top_template(df: DataFrame, text: str, group: str, chars: int = 80) -> DataFrame:
    """DD6: share of the most frequent normalised beginning in each group."""
    start = norm_words(F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars))
    counts = df.groupBy(group, start.alias("_start")).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg((F.max("n") / F.sum("n")).alias("top_share"), F.sum("n").alias("n"))


def completeness(df: DataFrame, fields: list[str], by: str | None = None, mode: str = "any") -> DataFrame:
    """A1: percent of rows whose field isn't missing, one row per group and field, one scan."""
    aggs = [F.avg(F.when(missing(F.col(f).cast("string"), mode), 0.0).otherwise(100.0)).alias(f) for f in fields]
    wide = (df.groupBy(by) if by else df.groupBy(F.lit("all").alias("all"))).agg(*aggs)
    return wide.unpivot([by or "all"], fields, "field", "percent")


def crosstab(df: DataFrame, row: str, col: Column, values: list) -> DataFrame:
    """A3, A5: counts by row and known values."""
    return df.groupBy(row).agg(*(F.sum(F.when(col.eqNullSafe(F.lit(v)), 1).otherwise(0)).alias(f"n_{v}") for v in values))


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent known values and their percent of the known; ties by value."""
    known = df.where(~missing(F.col(value)))
    counts = known.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), value).limit(k).join(F.broadcast(total)).select(value, "n", (100 * F.col("n") / F.col("total")).alias("percent"))


def interval_counts(since: DataFrame, unit: str, point: str, n: str) -> DataFrame:
    """Counts between checkpoints by subtraction of counts from a checkpoint on."""
    later = F.lead(n).over(W.partitionBy(unit).orderBy(point))
    return since.withColumn("between", F.col(n) - later).withColumn("negative", F.col("between") < 0)


def keep_unambiguous(df: DataFrame, name: str, code: str) -> DataFrame:
    """Names with exactly one code."""
    return df.where(F.col(code).isNotNull()).groupBy(name).agg(F.min(code).alias(code), F.max(code).alias("_most")).where(F.col(code) == F.col("_most")).drop("_most")


def stratified(df: DataFrame, strata: list[str], key: str, n: int, weight: str, seed: int = 1) -> DataFrame:
    """N rows of each stratum by a hash of the key, weights times N/n. Ranks need no more than n rows of a task (a bounded top-k by stratum)."""
    h = uniform(seed, F.col(key))
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*strata).orderBy(h, key))).where(F.col("_rn") <= n)
    return ranked.join(sizes, strata).withColumn(weight, F.col(weight) * F.col("_size") / F.least(F.col("_size"), F.lit(n))).drop("_rn", "_size")
