"""SC1 to SC9: JSON lines, CSV with a byte-order mark, tables, page records, wrapped answers, gazetteers, areas and trend files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTING = "id bigint, source string, source_id string, title string, description string, organization string, location string, location_code string, occupations array<string>, sectors array<string>, skills array<string>, upload_date string"
PAGE = f"source string, day string, total bigint, page int, page_size int, n int, items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in POSTING.split(', '))}>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """SC1, SC2: one object per line of all files, blank lines skipped, with an explicit schema."""
    return spark.read.schema(schema).json(paths)


def pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per posting of page records, with its page's day and total and its place (file, page, item)."""
    raw = json_lines(spark, paths, PAGE).select("day", "total", "page", F.col("_metadata.file_name").alias("file"), F.posexplode("items").alias("item", "posting"))
    return raw.select("day", "total", "file", "page", "item", "posting.*")


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SC3, SC4: header row; a byte-order mark before the first name goes."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def keyed_counts(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """SC6: a JSON object whose keys are 'a|b|c', as columns of the parts and n."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("k", "n"))
    keys = F.split("k", r"\|")
    return pairs.select(*(F.get(keys, i).alias(p) for i, p in enumerate(parts)), "n")


def unwrapped(spark: SparkSession, path: str, row: str) -> DataFrame:
    """SC8: rows of an answer that is a list, or an object with items, data, results or rows."""
    names = ("items", "data", "results", "rows")
    value, kind = F.col("value"), f"array<struct<{row}>>"
    inner = F.from_json(value, ", ".join(f"{n} {kind}" for n in names))
    rows = F.when(F.ltrim(value).startswith("["), F.from_json(value, kind)).otherwise(F.coalesce(*(inner[n] for n in names)))
    return spark.read.text(path, wholetext=True).select(F.explode(rows).alias("r")).select("r.*")


#: Fixed value: the columns of a gazetteer's file, which has no header.
GAZETTEER = "id bigint, name string, plain string, others string, lat double, lon double, class string, code string, country string"


def gazetteer(spark: SparkSession, path: str, classes: tuple = ("P",), codes: tuple = ("ADM3", "ADM4")) -> DataFrame:
    """SC4: (name, lat, lon, country) for each name of the places of a class or code, alternate names among them; tab-separated, without quotes."""
    rows = spark.read.schema(GAZETTEER).option("sep", "\t").option("quote", "").csv(path)
    rows = rows.where(F.col("class").isin(list(classes)) | F.col("code").isin(list(codes)))
    names = F.array_distinct(F.array_compact(F.concat(F.array("name", "plain"), F.split(F.coalesce("others", F.lit("")), ","))))
    return rows.select("id", F.explode(names).alias("name"), "lat", "lon", "country").where(F.trim("name") != "")


def features(spark: SparkSession, path: str, country: str, level: int, country_field: str = "CNTR_CODE", level_field: str = "LEVL_CODE", id_field: str = "NUTS_ID") -> DataFrame:
    """SC5: (id, rings) of a feature collection's areas of one country and level. A ring is an array of points [x, y]; rings of all parts stand together,
    which is enough for the even-odd rule."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    prop = lambda k: F.try_element_at(F.col("f.properties"), F.lit(k))
    rows = rows.where((prop(country_field) == country) & (prop(level_field).cast("int") == level))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    shape = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json(shape, one)).otherwise(F.flatten(F.from_json(shape, many)))
    return rows.select(prop(id_field).alias("id"), rings.alias("rings"))


def trends(spark: SparkSession, glob: str) -> DataFrame:
    """SC7: (source, location_code, month, n) of trend files, the source from the file's name after 'trend_'; months come as MM/YYYY."""
    rows = spark.read.schema("location_code string, Date string, Freq bigint").option("multiLine", True).json(glob)
    rows = rows.select(F.regexp_extract("_metadata.file_name", r"^(?:trend_)?(.*)\.json$", 1).alias("source"), "location_code", "Date", F.col("Freq").alias("n"))
    return rows.select("source", "location_code", F.concat(F.substring("Date", 4, 4), F.lit("-"), F.substring("Date", 1, 2)).alias("month"), "n")


def code_counts(spark: SparkSession, path: str) -> DataFrame:
    """SC9: (code, n) of JSON lines of unknown field names: the first number is the count, the first text the code."""
    text = spark.read.text(path).where(F.trim("value") != "")
    fields = text.select("value", F.from_json("value", "map<string,string>").alias("m")).select(F.map_values("m").alias("v"))
    number = F.filter("v", lambda x: x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
    name = F.filter("v", lambda x: ~x.rlike(r"^-?[0-9]+(\.[0-9]+)?$") & (x != ""))
    return fields.select(F.get(name, 0).alias("code"), F.get(number, 0).cast("double").cast("bigint").alias("n")).where("n is not null")
