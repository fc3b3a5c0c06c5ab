"""Records and answers of unknown shape, read as VARIANT: which fields they have, filled how often, and what an answer's rows look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of keys that may hold a date: fixed values.
DATE_LIKE = "date|time|created|updated|scrap|collect|crawl|insert|expir|valid|deadline|publish|posted|start|end"


def filled(v: str) -> Column:
    """Whether a VARIANT holds something: not null, "", [] or {}."""
    return F.expr(f"coalesce(to_json({v}) not in ('null', '\"\"', '[]', '{{}}'), false)")


def shown(v: str, length: int) -> Column:
    """A VARIANT as text, cut to a length: a string without its quotes."""
    return F.expr(f"substring(coalesce(try_variant_get({v}, '$', 'string'), to_json({v})), 1, {length})")


def is_a(kind: str, v: str) -> Column:
    return F.expr(f"startswith(schema_of_variant({v}), '{kind}')")


def number(v: str) -> Column:
    """The number that a VARIANT holds; null for anything else, true and false included."""
    return F.expr(f"if(schema_of_variant({v}) rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL)', try_variant_get({v}, '$', 'double'), null)")


def exploded(df: DataFrame, v: str) -> DataFrame:
    """df with pos, key and value of each field or item of the VARIANT v; one that has none gives no row."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(v).outer()))


def field_audit(df: DataFrame, record: str, dated: Column, date_like: str = DATE_LIKE, examples: int = 3) -> DataFrame:
    """P10: per field of the records (JSON texts), and per field one level below (of an object, or of the first item of a list, if that is an object), how many dated and undated records have it
    filled, these as shares of all dated and undated records, and for keys that look like dates the least `examples` values (60 characters each). null, "", [] and {} aren't filled. A record that is null or no
    JSON object counts as a record without fields; one whose `dated` is null is undated. No records give no rows."""
    rows = df.select(F.coalesce(dated, F.lit(False)).alias("dated"), F.expr(f"try_parse_json({record})").alias("v"))
    totals = rows.agg(F.count_if("dated").alias("all_dated"), F.count_if(~F.col("dated")).alias("all_undated"))
    top = exploded(rows.where(is_a("OBJECT", "v")), "v").select("dated", F.col("key").alias("path"), F.col("key").alias("name"), F.lit(0).alias("level"), F.col("value").alias("item"))
    inner = top.withColumn("item", F.when(is_a("ARRAY", "item"), F.expr("try_variant_get(item, '$[0]', 'variant')")).otherwise(F.col("item"))).where(is_a("OBJECT", "item"))
    below = exploded(inner, "item").select("dated", F.concat_ws(".", "path", "key").alias("path"), F.col("key").alias("name"), F.lit(1).alias("level"), F.col("value").alias("item"))
    fields = top.union(below).withColumns({"full": filled("item"), "like": F.col("name").rlike("(?i)" + date_like)})
    counts = fields.groupBy("path", "level").agg(F.count_if(F.col("dated") & F.col("full")).alias("dated"), F.count_if(~F.col("dated") & F.col("full")).alias("undated"))
    # The least values of each of 64 parts, and of those the least: a field may have as many values as there are records.
    values = fields.where("full and `like`").select("path", "level", shown("item", 60).alias("text")).distinct().withColumn("part", F.pmod(F.xxhash64("text"), F.lit(64)))
    rank = F.row_number().over(W.partitionBy("path", "level", "part").orderBy("text"))
    few = values.withColumn("rank", rank).where(F.col("rank") <= examples).groupBy("path", "level").agg(F.slice(F.sort_array(F.collect_list("text")), 1, examples).alias("examples"))
    out = counts.join(few, ["path", "level"], "left").join(F.broadcast(totals))  # one row
    return out.select("path", "level", "dated", "undated", F.try_divide("dated", "all_dated").alias("dated_share"), F.try_divide("undated", "all_undated").alias("undated_share"), "examples")


def describe(df: DataFrame, key: str, answer: str, codes: tuple[str, ...] = ("location_code", "location", "country")) -> DataFrame:
    """PB15: per answer (a JSON text) its kind and, of a list, the number of rows, the fields and the numeric fields of the first row (by name), whether the rows descend by the first numeric one, that
    one's first and last value and sum, the first of `codes` that the first row has and its number of distinct values. Rows without a number in that field are passed over in its values; a row without a
    code counts as the code ''. An answer that is null or no JSON has kind null; what isn't a list has 0 rows. Keys need to be distinct; further columns are ignored."""
    base = df.select(F.col(key).alias("id"), F.expr(f"try_parse_json({answer})").alias("v"))
    kinds = base.select("id", F.nullif(F.lower(F.regexp_extract(F.expr("schema_of_variant(v)"), "^[A-Z]+", 0)), F.lit("null")).alias("kind"))
    rows = exploded(base.where(is_a("ARRAY", "v")), "v").where("pos is not null").select("id", F.col("pos").alias("place"), F.col("value").alias("item"))
    first = exploded(rows.where((F.col("place") == 0) & is_a("OBJECT", "item")).select("id", "item"), "item").select("id", F.col("key").alias("name"), number("value").isNotNull().alias("numeric"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("rows"))
    code = F.coalesce(*(F.max(F.when(F.col("name") == c, F.lit(c))) for c in codes))
    heads = first.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("fields"), F.sort_array(F.collect_set(F.when(F.col("numeric"), F.col("name")))).alias("numeric_fields"), code.alias("code"))
    heads = heads.withColumn("by", F.get("numeric_fields", 0))
    cells = exploded(rows.where(is_a("OBJECT", "item")), "item").select("id", "place", F.col("key").alias("name"), number("value").alias("n"), shown("value", 1000).alias("text"))
    values = cells.join(heads.select("id", F.col("by").alias("name")), ["id", "name"]).where("n is not null")
    values = values.withColumn("before", F.lag("n").over(W.partitionBy("id").orderBy("place")))
    sums = values.groupBy("id").agg(F.min(F.coalesce(F.col("before") >= F.col("n"), F.lit(True))).alias("descends"), F.min_by("n", "place").alias("first"), F.max_by("n", "place").alias("last"), F.sum("n").alias("sum"))
    coded = rows.select("id", "place").join(heads.where("code is not null").select("id", F.col("code").alias("name")), "id").join(cells.select("id", "place", "name", "text"), ["id", "place", "name"], "left")
    distinct = coded.groupBy("id").agg(F.countDistinct(F.coalesce("text", F.lit(""))).alias("code_values"))
    out = kinds.join(sizes, "id", "left").join(heads, "id", "left").join(sums, "id", "left").join(distinct, "id", "left")
    return out.select(F.col("id").alias(key), "kind", F.coalesce("rows", F.lit(0)).alias("rows"), "fields", "numeric_fields", "descends", "first", "last", "sum", "code", "code_values")


def other_counts(cells: DataFrame, window: str, code: str, n: str, listed: list[str], total: str = "TOTAL") -> DataFrame:
    """PB10: per window the total, the sum of the listed codes, and the rest. A count that is null or missing is unknown: where one listed code is, so is their sum, and with it the rest; ignored is true where a
    listed code equals a total above 0, which says that the count's filter did nothing. Of several counts of a window and code the largest is taken. Codes that are neither listed nor `total` are ignored."""
    one = cells.where(F.col(code).isin([*listed, total])).groupBy(window, code).agg(F.max(n).alias("_n"))
    own = F.when(F.col(code) != total, F.col("_n"))
    sums = one.groupBy(window).agg(F.max(F.when(F.col(code) == total, F.col("_n"))).alias("total"), F.count(own).alias("_known"), F.sum(own).alias("_sum"), F.collect_set(own).alias("_all"))
    whole = F.when(F.col("_known") == len(set(listed)), F.coalesce("_sum", F.lit(0)))
    return sums.select(window, "total", whole.alias("listed"), (F.col("total") - whole).alias("other"), F.coalesce((F.col("total") > 0) & F.array_contains("_all", F.col("total")), F.lit(False)).alias("ignored"))
