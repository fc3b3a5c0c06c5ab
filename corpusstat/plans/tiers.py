"""Queries of tiers: orders as profiles, of which some have skills, some an occupation's address, some its name, and some neither."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import profiles as P
from corpusstat.plans.queries import query, rounded
from corpusstat.plans.texts import order_profiles
from corpusstat.sources.readers import table as t

TIERS = """
WITH a AS (SELECT o_orderkey, o_orderpriority AS s, o_orderstatus AS g, CASE WHEN o_orderkey % 4 = 1 THEN 'u/' || o_custkey % 50 END AS uri, CASE WHEN o_orderkey % 4 = 2 THEN 'Senior trade ' || o_custkey % 60 END AS job FROM orders),
b AS (SELECT DISTINCT o_orderkey, s, g, p_brand AS k FROM a JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey % 4 = 0), own AS (SELECT o_orderkey, string_agg(k, ',' ORDER BY k) AS skills FROM b GROUP BY 1),
f AS (SELECT 'u/' || l_suppkey % 30 AS occ, p_brand AS k, min({'o': l_returnflag = 'R', 'p': l_orderkey * 10 + l_linenumber}) AS spot FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), occ AS (SELECT occ, string_agg(k, ',' ORDER BY spot, k) AS skills FROM f GROUP BY 1),
lab AS (SELECT DISTINCT 'trade ' || s_suppkey % 30 AS label, 'u/' || s_suppkey % 30 AS occ FROM supplier), j AS (SELECT DISTINCT job, lower(trim(job)) AS q FROM a WHERE job IS NOT NULL),
m AS (SELECT job, occ, row_number() OVER (PARTITION BY job ORDER BY q = label DESC, length(label) DESC, label) AS rn FROM j JOIN lab ON contains(q, label) OR contains(label, q)),
z AS (SELECT s, g, count(DISTINCT o_orderkey) AS n FROM b GROUP BY 1, 2), y AS (SELECT s, count(DISTINCT o_orderkey) AS n FROM b GROUP BY 1), c AS (SELECT s, g, k, count(*) AS n FROM b GROUP BY 1, 2, 3 UNION ALL SELECT s, NULL, k, count(*) FROM b GROUP BY 1, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY n DESC, k) AS rn FROM c), l AS (SELECT s, g, string_agg(k, ',' ORDER BY rn) AS skills FROM r WHERE rn <= 10 GROUP BY 1, 2),
u AS (SELECT o_orderkey, a.s, CASE WHEN z.n >= 20 THEN a.g END AS g FROM a JOIN y ON y.s = a.s AND y.n >= 20 LEFT JOIN z ON z.s = a.s AND z.g = a.g),
d AS (SELECT o_orderkey, skills, CASE WHEN u.g IS NULL THEN 'sector_only' ELSE 'sector_degree' END AS kind FROM u JOIN l ON l.s = u.s AND l.g IS NOT DISTINCT FROM u.g),
e AS (SELECT a.o_orderkey, own.skills AS s1, x.skills AS s2, v.skills AS s3, d.skills AS s4, kind FROM a LEFT JOIN own USING (o_orderkey) LEFT JOIN occ x ON x.occ = a.uri LEFT JOIN m ON m.job = a.job AND rn = 1 LEFT JOIN occ v ON v.occ = m.occ LEFT JOIN d ON d.o_orderkey = a.o_orderkey),
p AS (SELECT o_orderkey, CASE WHEN s1 IS NOT NULL THEN 1 WHEN coalesce(s2, s3) IS NOT NULL THEN 2 WHEN s4 IS NOT NULL THEN 3 ELSE 4 END AS tier, CASE WHEN s1 IS NOT NULL THEN 'direct' WHEN s2 IS NOT NULL THEN 'occupation_uris' WHEN s3 IS NOT NULL THEN 'occupation_text_exact' ELSE coalesce(kind, 'none') END AS mechanism,
  coalesce(s1, s2, s3, s4, '') AS skills FROM e)"""


def tiered(spark, d):
    key = F.col("o_orderkey") % 4
    orders = t(spark, d, "orders").select("o_orderkey", F.when(key == 1, F.array(F.concat(F.lit("u/"), F.col("o_custkey") % 50))).alias("occupation_uris"), F.when(key == 2, F.concat(F.lit("Senior trade "), F.col("o_custkey") % 60)).alias("occupation"))
    rows = order_profiles(spark, d).withColumn("skills", F.when(key == 0, F.col("skills")).otherwise(F.array().cast("array<string>"))).join(orders, "o_orderkey")
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    relations = t(spark, d, "lineitem").join(parts, "l_partkey").select(F.concat(F.lit("u/"), F.col("l_suppkey") % 30).alias("occupation"), F.col("p_brand").alias("skill"), F.when(F.col("l_returnflag") == "R", "optional").otherwise("essential").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    labels = t(spark, d, "supplier").select(F.concat(F.lit("trade "), F.col("s_suppkey") % 30).alias("label"), F.concat(F.lit("u/"), F.col("s_suppkey") % 30).alias("uri")).distinct()
    return P.tiers(rows, relations, labels, "o_orderkey", "u/")


@query(TIERS + "\nSELECT o_orderkey, tier::BIGINT AS tier, mechanism, skills FROM p")
def p1_tiers(spark, d):
    out = tiered(spark, d)
    return rounded(out.select("o_orderkey", "tier", "mechanism", F.array_join("skills_used", ",").alias("skills")))


@query(TIERS + "\nSELECT tier::BIGINT AS tier, mechanism, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1, 2")
def pb3_tier_counts(spark, d):
    """Profiles by tier and by the way that they got there."""
    counts = tiered(spark, d).groupBy("tier", "mechanism").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))
    return rounded(counts.join(F.broadcast(whole)).select("tier", "mechanism", "n", (F.col("n") / F.col("_all")).alias("share")))  # one row
