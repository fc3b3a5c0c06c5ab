"""Board statistics for titles, places and employers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.functions import prepare as P

#: Fixed value: small words, which titles write either way.
SMALL = "the a an of and or in to for at with de la le du des der die das och i på för".split()


def board_places(df: DataFrame, location: str, least: int = 3) -> DataFrame:
    """Parts of locations, hyphens as blanks, of 3 to 40 characters and not all digits, found in at least so many rows' parts."""
    pieces = F.explode(F.split(F.coalesce(location, F.lit("")), r"[,/;()]| - "))
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace("piece", r"[-‐–]", " "), r"\s+", " ")))
    rows = df.select(pieces.alias("piece")).select(name.alias("place"))
    return rows.where(F.length("place").between(3, 40) & ~F.col("place").rlike("^[0-9]+$")).groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def title_case(df: DataFrame, title: str) -> DataFrame:
    """(word, low, cap): how often each word stands in titles (not first) in lower case and capitalised; titles all in capitals don't count."""
    shown = df.where((F.coalesce(title, F.lit("")) != "") & ~((F.upper(title) == F.col(title)) & (F.lower(title) != F.col(title))))
    words = shown.select(F.explode(F.slice(F.split(F.trim(F.regexp_replace(title, r"\s+", " ")), " "), F.lit(2), F.lit(10_000))).alias("w"))
    clean = words.select("w", F.lower(F.regexp_replace("w", r"(?U)^[\W_]+|[\W_]+$", "")).alias("word"))
    clean = clean.where(F.col("word").rlike(r"^\p{L}{3,}$") & ~F.col("word").isin(SMALL))
    big = F.col("w").rlike(r"^\p{Lu}")
    return clean.groupBy("word").agg(F.count_if(~big).alias("low"), F.count_if(big).alias("cap"))


def common_words(cases: DataFrame, least: int = 5, part: float = 0.5) -> DataFrame:
    """Words that the board writes in lower case at least half of the time, in at least so many uses."""
    n = F.col("low") + F.col("cap")
    return cases.where((n >= least) & (F.col("low") / n >= part)).select("word")


def title_case_share(cases: DataFrame) -> DataFrame:
    """Share of capitalised words inside titles; high on boards where capitals tell nothing."""
    return cases.agg((F.sum("cap") / F.greatest(F.lit(1), F.sum("cap") + F.sum("low"))).alias("share"))


def frequent_endings(df: DataFrame, title: Column, least: int = 25) -> DataFrame:
    """Last segments that end at least so many titles: employers without a legal form, and places."""
    ends = df.select(P.last_segment(title).alias("ending")).where("ending is not null")
    return ends.groupBy("ending").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def resolve_places(df: DataFrame, key: str, location: str, region: str, tables: list[tuple[str, DataFrame]], out: list[str] = ("OUT", "VAGUE")) -> DataFrame:
    """(key, region, method) by the first that knows: the row's own field, then each table (name, region) in order, the first part of the location
    before the later ones. A table may say OUT (abroad) or VAGUE; then there is no region, and the method says so. Tables have one region a name."""
    parts = df.select(key, F.nullif(F.col(region), F.lit("")).alias("_field"), P.location_parts(F.col(location)).alias("_parts"))
    rows = parts.select(key, "_field", F.posexplode_outer("_parts").alias("_at", "name"))
    names = []
    for i, (method, table) in enumerate(tables):
        rows = rows.join(table.select("name", F.col("region").alias(f"_r{i}")), "name", "left")
        names.append(F.when(F.col(f"_r{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.col("_at").alias("at"), F.col(f"_r{i}").alias("region"), F.lit(method).alias("method"))))
    # least() of structs: the first table, then the first part
    found = F.least(*names) if len(names) > 1 else names[0]
    best = rows.groupBy(key).agg(F.first("_field").alias("_field"), F.min(found).alias("_best"))
    known = F.col("_best.region")
    return best.select(key, F.coalesce("_field", F.when(~known.isin(list(out)), known)).alias("region"),
                       F.when(F.col("_field").isNotNull(), "field").when(known.isin(list(out)), F.lower(known)).otherwise(F.coalesce("_best.method", F.lit("unplaced"))).alias("method"))


def sources_known(rows: DataFrame, source: str, merged: DataFrame, boards: DataFrame) -> DataFrame:
    """X32 with tables of any length: rows with label, platform and country of their source, from merged (source, label) and boards (source, platform, country). A source that a table
    names more than once gets its least row; one that no table names is its own label and platform."""
    one = lambda df, *c: df.groupBy(F.col("source").alias("_source")).agg(F.min(F.struct(*c)).alias("_found")).select("_source", *(F.col(f"_found.{x}").alias(f"_{x}") for x in c))
    out = rows.withColumn("_source", F.col(source)).join(one(merged, "label"), "_source", "left").join(one(boards, "platform", "country"), "_source", "left")
    return out.select(*rows.columns, F.coalesce("_label", source).alias("label"), F.coalesce("_platform", source).alias("platform"), F.col("_country").alias("country"))
