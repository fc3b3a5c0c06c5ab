"""Queries of the core report, of joins with tags and labels, and of the filters, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.functions import text as X
from corpusstat.operators import relate as R
from corpusstat.operators import series as S
from corpusstat.plans.queries import query, rounded
from corpusstat.sources.readers import table as t

#: Orders as postings: the customer's segment is the channel, the customer's nation the region, and most orders have a cluster.
POSTINGS = """posting AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(1 + o_custkey % 4 AS DOUBLE) AS w,
  CASE WHEN o_custkey % 11 = 0 THEN -2 WHEN o_custkey % 7 = 0 THEN -1 ELSE c_nationkey % 5 END AS cluster,
  CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment END AS channel, CASE WHEN o_orderkey % 8 <> 0 THEN n_name END AS region,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS title, substr(c_name, 1, 14) AS template
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def postings(spark, d):
    key = F.col("o_orderkey")
    names = t(spark, d, "nation").select("n_nationkey", "n_name")
    people = t(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "c_mktsegment", "c_name", "n_name")
    df = t(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return df.select(
        key.alias("id"), F.to_date("o_orderdate").alias("day"), (1 + F.col("o_custkey") % 4).cast("double").alias("w"),
        F.when(F.col("o_custkey") % 11 == 0, -2).when(F.col("o_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey") % 5).alias("cluster"),
        F.when(key % 3 == 0, F.col("c_mktsegment")).alias("channel"), F.when(key % 8 != 0, F.col("n_name")).alias("region"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.substring("c_name", 1, 14).alias("template"),
    )


SERIES = f"""WITH {POSTINGS},
cell AS (SELECT cluster, day, count(*) AS c, sum(w) AS w FROM posting GROUP BY 1, 2),
dd AS (SELECT day, sum(c) AS n, sum(w) AS ww, year(day) || '-Q' || quarter(day) AS period, date_trunc('quarter', day)::DATE AS f, (date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS l FROM cell GROUP BY 1),
span AS (SELECT period, count(*) AS days, sum(ww) AS population, date_diff('day', greatest(any_value(f), (SELECT min(day) FROM dd)), least(any_value(l), (SELECT max(day) FROM dd))) + 1 AS calendar_days FROM dd GROUP BY 1),
taken AS (SELECT cluster, period, sum(c) AS taken, sum(ww * c / n) AS weighted FROM cell JOIN dd USING (day) GROUP BY 1, 2),
series AS (SELECT cluster, period, days, calendar_days, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(weighted, 0) / population AS share, coalesce(weighted, 0) AS weighted,
  coalesce(weighted, 0) * calendar_days / days AS adjusted, days >= 80 AS usable FROM (SELECT DISTINCT cluster FROM cell) CROSS JOIN span LEFT JOIN taken USING (cluster, period))"""


def series(spark, d):
    first = lambda c: F.to_date(F.date_trunc("quarter", c))
    last = lambda c: F.date_sub(F.add_months(first(c), 3), 1)
    return S.cluster_series(postings(spark, d), "cluster", "day", "w", X.quarter, first, last, 80)


@query(SERIES + "SELECT cluster, period, days, calendar_days, taken, round(share, 6) AS share, round(weighted, 6) AS weighted, round(adjusted, 6) AS adjusted, usable FROM series")
def a19_cluster_series(spark, d):
    return rounded(series(spark, d))


@query(SERIES + """, one AS (SELECT cluster, min(period) AS first_cross FROM series WHERE usable AND cluster >= 0 AND share >= 0.18 GROUP BY 1)
SELECT period, count(*) FILTER (WHERE share >= 0.18) AS active, CASE WHEN period = (SELECT min(period) FROM series WHERE usable) THEN 0 ELSE (SELECT count(*) FROM one WHERE first_cross = period) END AS new
FROM series WHERE usable AND cluster >= 0 GROUP BY period""")
def w2_emergence_rate(spark, d):
    return rounded(S.emergence_rate(series(spark, d), 0.18, "share"))


@query(f"""WITH {POSTINGS}, a AS (SELECT CAST(cluster AS VARCHAR) AS cluster, year(day) || '-Q' || quarter(day) AS period, region, w FROM posting),
b AS (SELECT * FROM a UNION ALL SELECT 'ALL', period, region, w FROM a), c AS (SELECT * FROM b UNION ALL SELECT cluster, 'all', region, w FROM b),
s AS (SELECT cluster, period, region, count(*) AS n, sum(w) AS w FROM c GROUP BY 1, 2, 3),
h AS (SELECT cluster, period, CAST(coalesce(sum(n) FILTER (WHERE region IS NOT NULL), 0) AS BIGINT) AS placed, sum(w) FILTER (WHERE region IS NOT NULL) AS p, sum(w * w) FILTER (WHERE region IS NOT NULL) AS sq, sum(w) AS al FROM s GROUP BY 1, 2)
SELECT cluster, period, placed, round(sq / (p * p), 6) AS hhi, round((sq / (p * p) - 1.0 / 25) / (1 - 1.0 / 25), 6) AS hhi_norm, round(1 - coalesce(p, 0) / al, 6) AS unplaced_share, placed >= 30 AS reliable FROM h""")
def a21_region_report(spark, d):
    return rounded(S.region_concentration(postings(spark, d), "cluster", X.quarter(F.col("day")), "region", "w", 25, 30))


@query(SERIES + """, top AS (SELECT cluster, channel AS top_channel, sum(w) AS v, row_number() OVER (PARTITION BY cluster ORDER BY sum(w) DESC, channel) AS r FROM posting WHERE channel IS NOT NULL GROUP BY 1, 2),
same AS (SELECT cluster, max(n) AS same FROM (SELECT cluster, template, count(*) AS n FROM posting GROUP BY 1, 2) GROUP BY 1),
tt AS (SELECT cluster, string_agg(title, ' | ' ORDER BY r) AS top_titles FROM (SELECT cluster, title, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, title) AS r FROM posting WHERE title <> '' GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
peak AS (SELECT cluster, period AS peak_period, adjusted AS peak_adjusted FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY adjusted DESC, period DESC) AS r FROM series WHERE usable) WHERE r = 1),
fc AS (SELECT cluster, min(period) AS first_cross FROM series WHERE usable AND cluster >= 0 AND adjusted >= 300 GROUP BY 1),
b AS (SELECT cluster, count(*) AS taken, sum(w) AS weighted_total, sum(CASE WHEN channel IS NOT NULL THEN w ELSE 0 END) AS flagged, count(*) FILTER (WHERE title = '') AS untitled FROM posting GROUP BY 1),
s2 AS (SELECT cluster, taken, round(weighted_total, 6) AS weighted_total, peak_period, round(peak_adjusted, 6) AS peak_adjusted, first_cross, round(flagged / weighted_total, 6) AS flagged_share, top_channel,
  round(CASE WHEN flagged > 0 THEN v / flagged END, 6) AS top_channel_share, round(CAST(same AS DOUBLE) / taken, 6) AS template_share, round(CAST(untitled AS DOUBLE) / taken, 6) AS titleless_share, top_titles
  FROM b LEFT JOIN peak USING (cluster) LEFT JOIN fc USING (cluster) LEFT JOIN (SELECT * FROM top WHERE r = 1) USING (cluster) LEFT JOIN same USING (cluster) LEFT JOIN tt USING (cluster))
SELECT *, cluster >= 0 AND first_cross IS NOT NULL AND template_share < 0.5 AND titleless_share <= 0.5 AS eligible FROM s2""")
def a33_cluster_summary(spark, d):
    """With the eligibility of F5."""
    out = S.cluster_summary(postings(spark, d), series(spark, d), "cluster", "w", "channel", F.col("template"), "title", 300.0)
    return rounded(R.eligible(out))


@query(SERIES + """, peak AS (SELECT cluster, max(share) AS peak FROM series GROUP BY 1)
SELECT CAST(line AS DOUBLE) AS line, count(*) FILTER (WHERE peak >= line) AS reach, count(*) AS units FROM peak, (VALUES (0.05), (0.15), (0.25)) v(line) GROUP BY line""")
def f6_presence_lines(spark, d):
    return rounded(R.presence_lines(series(spark, d), "cluster", "share", [0.05, 0.15, 0.25]))


def share_cells(spark, d):
    df = postings(spark, d)
    return S.day_cells(df.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"], "day", F.col("channel") == "BUILDING", "w")


@query()
def e6_within_day_interval(spark, d):
    return rounded(S.within_day_interval(share_cells(spark, d), ["month"]))


@query()
def e10_surge_interval(spark, d):
    """Each channel's share in 1996 against 1995."""
    df = postings(spark, d).where(F.year("day").isin(1995, 1996))
    # every day has a row for each channel, whose n and W are the whole day's
    days = S.day_cells(df, [], "day", F.lit(False), "w").drop("c")
    hits = df.where("channel is not null").groupBy("channel", "day").agg(F.count("*").alias("c"))
    grid = hits.select("channel").distinct().crossJoin(days)  # channels by days of the calendar
    cells = grid.join(hits, ["channel", "day"], "left").fillna(0, ["c"]).withColumn("later", F.year("day") == 1996)
    return rounded(S.ratio_of_shares(cells, ["channel"], "later"))


@query()
def e11_lift_interval(spark, d):
    """Share of a region's rows in a channel's against its share in all rows."""
    df = postings(spark, d).where("region is not null")
    inside = S.day_cells(df.where("channel = 'BUILDING'"), [], "day", F.lit(False), "w").drop("c").withColumn("inside", F.lit(True))
    every = S.day_cells(df, [], "day", F.lit(False), "w").drop("c").withColumn("inside", F.lit(False))
    hits = df.select("region", "day", F.explode(F.when(F.coalesce(F.col("channel"), F.lit("")) == "BUILDING", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("inside"))
    hits = hits.groupBy("region", "day", "inside").agg(F.count("*").alias("c"))
    grid = df.select("region").distinct().crossJoin(inside.union(every.select(inside.columns)))  # regions by days
    return rounded(S.ratio_of_shares(grid.join(hits, ["region", "day", "inside"], "left").fillna(0, ["c"]), ["region"], "inside"))


# Joins and filters

TAGS = """tag AS (SELECT o_orderkey AS id, o_orderkey % 9 <> 0 AS ok, CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE ['reshoring', 'defense', 'critical materials', 'energy security', 'trade compliance', 'diversification', 'other'][1 + o_custkey % 7] END AS channel,
  ['low', 'medium', 'high', NULL, ''][1 + o_orderkey % 5] AS intensity FROM orders WHERE o_orderkey % 4 <> 0)"""


def tags(spark, d):
    names = F.array(*(F.lit(c) for c in [*R.CHANNELS, "other"]))
    levels = F.array(*(F.lit(c) for c in ("low", "medium", "high", None, "")))
    df, key = t(spark, d, "orders").where("o_orderkey % 4 <> 0"), F.col("o_orderkey")
    channel = F.when(key % 13 == 0, "none").otherwise(F.get(names, (F.col("o_custkey") % 7).cast("int")))
    return df.select(key.alias("id"), (key % 9 != 0).alias("ok"), channel.alias("channel"), F.get(levels, (key % 5).cast("int")).alias("intensity"))


@query(f"WITH {TAGS} SELECT coalesce(channel, 'none') AS channel, count(*) AS n FROM orders LEFT JOIN tag ON o_orderkey = id GROUP BY 1")
def j2_tag_default(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return R.with_tags(rows, tags(spark, d), "id", {"channel": "none"}).groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT coalesce(toxic, -2) AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def j3_label_default(spark, d):
    rows = t(spark, d, "documents").select("doc_id")
    return rounded(R.with_tags(rows, t(spark, d, "labels").select("doc_id", F.col("toxic").cast("int")), "doc_id", {"toxic": -2}).groupBy("toxic").agg(F.count("*").alias("n")))


@query(f"WITH {TAGS} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT id FROM tag)")
def j4_restrict(spark, d):
    """With J5."""
    return R.restrict(t(spark, d, "documents").select("doc_id", "source"), t(spark, d, "labels"), "doc_id", tags(spark, d).select(F.col("id").alias("doc_id")))


@query(f"WITH {TAGS} SELECT id, o_orderpriority, channel, intensity, CAST(NULL AS VARCHAR) AS evidence FROM orders JOIN tag ON o_orderkey = id ORDER BY channel, id")
def j1_tagged_export(spark, d):
    rows = t(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return R.tagged_export(rows, tags(spark, d), "id", ["id", "o_orderpriority", "channel", "intensity", "evidence"], ["channel", "id"])


@query(f"""WITH {TAGS} SELECT o_orderkey AS id, o_orderstatus AS stratum, o_totalprice AS weight, lower(trim(c_mktsegment)) AS truth, CASE WHEN ok IS NULL THEN 'none' WHEN NOT ok THEN 'invalid' ELSE coalesce(channel, 'none') END AS said
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN tag ON o_orderkey = id""")
def j8_scoring_join(spark, d):
    key = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stratum"), F.col("o_totalprice").alias("weight"))
    people = t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("truth"))
    sheet = t(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "truth")
    return R.scoring(key, sheet, tags(spark, d), "id")


TWO = "a AS (SELECT vec_id AS id, label % 6 - 1 AS label FROM embeddings WHERE vec_id % 3 <> 0), b AS (SELECT vec_id AS id, label // 2 - 1 AS label FROM embeddings WHERE vec_id % 4 <> 0)"


def two_labels(spark, d):
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.where("id % 3 <> 0").withColumn("label", F.col("label") % 6 - 1), rows.where("id % 4 <> 0").withColumn("label", F.floor(F.col("label") / 2).cast("int") - 1)


@query(f"WITH {TWO}, c AS (SELECT a.label, b.label AS base, count(*) AS n FROM a JOIN b USING (id) GROUP BY 1, 2) SELECT label, base, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS part FROM c")
def j14_origins(spark, d):
    return rounded(R.origins(*two_labels(spark, d), "id", "label"))


@query(f"""WITH {TWO}, p AS (SELECT a.label AS a, b.label AS b FROM a JOIN b USING (id)) SELECT count(*) AS n, round(avg(CASE WHEN a >= 0 AND b >= 0 THEN 1.0 ELSE 0 END), 6) AS "both", round(avg(CASE WHEN a >= 0 OR b >= 0 THEN 1.0 ELSE 0 END), 6) AS either,
round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) FILTER (WHERE a >= 0 AND b >= 0), 6) AS equal FROM p""")
def j16_share_in_both(spark, d):
    """With E20."""
    return rounded(R.share_in_both(R.in_both(*two_labels(spark, d), "id", "label")))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT c_custkey, c_nationkey AS known, coalesce(n, c_nationkey) AS total FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def j15_known_counts(spark, d):
    counts = t(spark, d, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return rounded(R.known_counts(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("known")), counts, ["c_custkey"]))


@query(f"""WITH {TAGS} SELECT channel, count(*) AS n FROM tag WHERE ok AND channel IN ('reshoring', 'defense', 'critical materials', 'energy security', 'trade compliance', 'diversification') AND intensity IN ('medium', 'high') GROUP BY 1""")
def f3_flagged(spark, d):
    return R.flagged(tags(spark, d), "medium").groupBy("channel").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-15' AND DATE '1996-03-10')
SELECT o_orderpriority, month, count(*) AS n FROM a WHERE month IN (SELECT month FROM a GROUP BY 1 HAVING count(DISTINCT day) >= 28) GROUP BY 1, 2""")
def f4_usable_periods(spark, d):
    """With F2."""
    df = R.between(t(spark, d, "orders"), "o_orderdate", "1995-01-15", "1996-03-10")
    df = df.select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.to_date("o_orderdate").alias("day"))
    return R.usable(df, "month", "day", 28).groupBy("o_orderpriority", "month").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT o_orderkey AS unit, p_brand AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT unit) AS n FROM r)
SELECT item, count(*) AS n FROM r WHERE item IN (SELECT item FROM r, n GROUP BY item, n.n HAVING count(*) <= 0.15 * n.n) GROUP BY 1""")
def f7_frequent_items_out(spark, d):
    parts = t(spark, d, "part").select("p_partkey", "p_brand")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("unit"), F.array("p_brand").alias("items"))
    return R.frequent_items_out(rows, "unit", F.col("items"), 0.15).groupBy("item").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, (' ' || lower(p_name) || ' ') LIKE '% green %' OR (' ' || lower(p_name) || ' ') LIKE '% steel rod %' OR ' green ' LIKE '%' || (' ' || lower(p_name) || ' ') || '%' OR ' steel rod ' LIKE '%' || (' ' || lower(p_name) || ' ') || '%'
 OR split_part(trim(lower(p_name)), ' ', 1) IN ('green', 'steel', 'rod') OR split_part(trim(lower(p_name)), ' ', -1) IN ('green', 'steel', 'rod') AS near FROM part""")
def f10_overlaps_seed(spark, d):
    return t(spark, d, "part").select("p_partkey", R.overlaps_seed(F.col("p_name"), ["green", "steel rod"]).alias("near"))


@query("""WITH m AS (SELECT o_orderpriority AS g, strftime(o_orderdate, '%Y-%m') AS month, count(*)::DOUBLE AS est FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1, 2)
SELECT g, min(est) AS smallest, count(*) FILTER (WHERE est IS NULL) AS unknown, min(est) >= 40 AS ok FROM m GROUP BY 1""")
def f11_enough(spark, d):
    df = t(spark, d, "orders").where("year(o_orderdate) = 1996").groupBy(F.col("o_orderpriority").alias("g"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").cast("double").alias("est"))
    return R.enough(df, "g", "est", 40.0)


DATED = "SELECT l_linenumber AS source, CASE WHEN l_orderkey % 6 <> 0 THEN l_shipdate END AS t FROM lineitem"


@query(f"""WITH a AS ({DATED}) SELECT CAST(source AS BIGINT) AS source, min(strftime(t, '%Y-%m')) AS first, max(strftime(t, '%Y-%m')) AS last, count(t) AS dated, count(*) AS n, count(*) - count(t) AS undated,
coalesce(min(strftime(t, '%Y-%m')) <= '1993-01' AND max(strftime(t, '%Y-%m')) >= '1998-01', false) AS covers FROM a GROUP BY 1""")
def f12_month_gates(spark, d):
    """With A4 and A13."""
    df = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("source"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_shipdate")).alias("at"))
    return rounded(R.month_gates(df, "source", "at", "1993-01", "1998-01"))


@query("""WITH a AS (SELECT event_id AS id, user_id % 7 AS page, CASE WHEN event_id % 9 <> 0 THEN ts END AS at FROM events WHERE event_id % 2 = 0 OR event_id % 5 = 0),
p AS (SELECT u.id, r.id AS near_id, r.at AS near_at, row_number() OVER (PARTITION BY u.id ORDER BY abs(u.id - r.id), r.id) AS k FROM a u JOIN a r ON r.id BETWEEN u.id - 400 AND u.id + 400 AND r.page <> u.page WHERE u.at IS NULL AND r.at IS NOT NULL)
SELECT id, near_id, near_at FROM p WHERE k = 1""")
def j10_nearest_date(spark, d):
    df = t(spark, d, "events").where("event_id % 2 = 0 or event_id % 5 = 0")
    return R.nearest_dated(df.select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("page"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("at")), "id", "page", "at", 50)


# Counts

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}')"


@query(f"""WITH a AS (SELECT unnest(CASE WHEN len(k) > 0 THEN k ELSE ['(none)'] END) AS label FROM (SELECT list_distinct(list_filter({WORDS}, lambda x: length(x) = 3)) AS k FROM documents))
SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percent FROM a GROUP BY 1""")
def a7_label_counts(spark, d):
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0)), lambda x: F.length(x) == 3)
    return rounded(S.label_counts(t(spark, d, "documents"), found, "(none)"))


@query(f"""WITH {POSTINGS} SELECT coalesce(nullif(channel, ''), '(none)') AS "group", count(*) AS n, round(100.0 * count(region) / count(*), 6) AS region, round(100.0 * count(*) FILTER (WHERE title <> '') / count(*), 6) AS title,
round(100.0 * count(*) FILTER (WHERE region IS NOT NULL OR cluster >= 0) / count(*), 6) AS anywhere, count(*) < 1000 AS starred FROM posting GROUP BY 1""")
def a8_filled_by(spark, d):
    """With A2 (any of several fields)."""
    fields = {"region": F.col("region").isNotNull(), "title": F.col("title") != "", "anywhere": F.col("region").isNotNull() | (F.col("cluster") >= 0)}
    return rounded(S.filled_by(postings(spark, d), F.col("channel"), fields, 1000))


@query("""WITH a AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN ['x', 'C' || lpad(CAST(p_partkey AS VARCHAR), 4, '0')] WHEN p_partkey % 4 = 1 THEN ['abc'] ELSE ['http://e.org/isco/' || lpad(CAST(p_size * 97 AS VARCHAR), 4, '0')] END AS codes, p_brand FROM part)
SELECT coalesce(nullif(substr(regexp_extract(list_filter(codes, lambda c: regexp_matches(c, '[Cc]?[0-9]{4}$'))[1], '([0-9]{4})$', 1), 1, 1), ''), '(none)') AS "group", count(*) AS n, round(100.0 * count(*) FILTER (WHERE p_brand > 'Brand#3') / count(*), 6) AS brand, count(*) < 30 AS starred FROM a GROUP BY 1""")
def a9_major_groups(spark, d):
    key, pad = F.col("p_partkey"), lambda c: F.lpad(c.cast("string"), 4, "0")
    codes = F.when(key % 4 == 0, F.array(F.lit("x"), F.concat(F.lit("C"), pad(key)))).when(key % 4 == 1, F.array(F.lit("abc"))).otherwise(F.array(F.concat(F.lit("http://e.org/isco/"), pad(F.col("p_size") * 97))))
    return rounded(S.filled_by(t(spark, d, "part"), S.major_group(codes), {"brand": F.col("p_brand") > "Brand#3"}))


@query("""WITH a AS (SELECT o_orderpriority AS source, count(*) FILTER (WHERE year(o_orderdate) = 1995) AS y1995, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS y1996, count(*) AS total FROM orders GROUP BY 1)
SELECT * FROM a UNION ALL SELECT 'all', sum(y1995)::BIGINT, sum(y1996)::BIGINT, sum(total)::BIGINT FROM a UNION ALL SELECT 'all except 1-URGENT', sum(y1995)::BIGINT, sum(y1996)::BIGINT, sum(total)::BIGINT FROM a WHERE source <> '1-URGENT'""")
def a10_year_pivot(spark, d):
    return S.year_pivot(t(spark, d, "orders").withColumnRenamed("o_orderpriority", "source"), "source", "o_orderdate", [1995, 1996], "1-URGENT")
