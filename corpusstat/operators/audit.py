"""Local audits of fields, buckets, tags and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_inventory(df: DataFrame, fields: str) -> DataFrame:
    """PB5, P10: of each key of a map column how many rows have it and how many have a value that isn't blank."""
    total = df.agg(F.count("*").alias("rows"))
    counts = df.select(F.explode(fields).alias("field", "v")).groupBy("field").agg(F.count("*").alias("present"), F.count_if(F.trim(F.coalesce("v", F.lit(""))) != "").alias("filled"))
    return counts.join(F.broadcast(total)).select("field", "rows", "present", "filled")  # one row


def bucket_sparsity(df: DataFrame, sector: str, degree: str, least: int) -> DataFrame:
    """PB6: buckets by sector and by sector and degree: how many, how many with at least `least` rows, the largest and the smallest."""
    cells = df.groupBy(sector, degree).agg(F.count("*").alias("n"))
    report = lambda rows, name: rows.agg(F.lit(name).alias("bucket"), F.count("*").alias("buckets"), F.count_if(F.col("n") >= least).alias("large"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return report(cells.groupBy(sector).agg(F.sum("n").alias("n")), "sector").union(report(cells, "sector and degree"))


def top_by_source(df: DataFrame, source: str, labels: Column, top: int, least: int) -> DataFrame:
    """PB7: each source's most frequent labels (ties by label), and how many rows of the source would be needed, at its largest label's share, to have `least` of it."""
    total = df.groupBy(source).agg(F.count("*").alias("_total"))
    counts = df.select(source, F.explode(F.array_distinct(labels)).alias("label")).groupBy(source, "label").agg(F.count("*").alias("n")).join(total, source)
    by = W.partitionBy(source)
    rows = counts.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("n"), "label")), "_most": F.max("n").over(by)})
    return rows.where(F.col("rank") <= top).select(source, "label", "n", "rank", F.ceil(F.col("_total") * least / F.col("_most")).cast("long").alias("projected"))


def fill_by(df: DataFrame, by: list[str], filled: Column) -> DataFrame:
    """PB8, PB16: rows and the percent of them with a value, by groups."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(filled, 100.0).otherwise(0.0)).alias("percent"))


def template_report(df: DataFrame, template: Column, channel: str, top: int) -> DataFrame:
    """PB18: the most frequent templates with their share of rows, their flagged share and their number of channels. Copies count: rows come from the raw pages."""
    total = df.agg(F.count("*").alias("_all"))
    counts = df.groupBy(template.alias("template")).agg(F.count("*").alias("n"), F.avg(F.when(F.col(channel).isNotNull(), 1.0).otherwise(0.0)).alias("flagged"), F.count_distinct(channel).alias("channels"))
    return counts.orderBy(F.desc("n"), "template").limit(top).join(F.broadcast(total)).select("template", "n", (F.col("n") / F.col("_all")).alias("share"), "flagged", "channels")


def least_similar(df: DataFrame, channel: str, value, similarity: str, key: str, top: int) -> DataFrame:
    """PB20: a channel's rows, the least similar first."""
    return df.where(F.col(channel) == value).orderBy(similarity, key).limit(top).select(key, similarity)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """A32, PB9: rows by value with their percent."""
    total = df.agg(F.count("*").alias("_all"))
    return df.groupBy(value).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(value, "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def pattern_share(df: DataFrame, by: list[str], text: Column, places: list[str], w: str) -> DataFrame:
    """Weighted share of the rows whose text names a place."""
    hit = F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(places))
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.when(hit, F.col(w)).otherwise(0.0)) / F.sum(w)).alias("share"))


def cross_tab(df: DataFrame, row: str, col: Column, values: list[str]) -> DataFrame:
    """Rows by row and known values, and all of them."""
    return df.groupBy(row).agg(*(F.count_if(col == v).alias(v) for v in values), F.count("*").alias("total"))
