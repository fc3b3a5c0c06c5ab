"""Queries of a peak: weeks, employers, what is left without the largest, and one week's wordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import peaks as K
from corpusstat.plans.queries import query, rounded
from corpusstat.plans.series import POSTINGS, postings

WINDOWS = [("1995-11-20", "1996-01-20"), ("1995-12-15", "1996-02-10")]
HIT = "channel = 'BUILDING'"


@query(f"""WITH {POSTINGS}, s("begin", "end") AS (VALUES {', '.join(f"(DATE '{a}', DATE '{b}')" for a, b in WINDOWS)})
SELECT "begin", date_trunc('week', day)::DATE AS week, count(*) AS taken, sum(w) AS population, round(sum(CASE WHEN channel IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) AS flagged, round(sum(CASE WHEN channel = 'BUILDING' THEN w ELSE 0 END) / sum(w), 6) AS tagged FROM posting JOIN s ON day BETWEEN "begin" AND "end" GROUP BY 1, 2""")
def p9_weeks(spark, d):
    return rounded(K.weekly(postings(spark, d), "day", "w", {"flagged": F.col("channel").isNotNull(), "tagged": F.expr(HIT)}, WINDOWS))


CELLS = f"""WITH {POSTINGS}, c AS (SELECT year(day) AS period, coalesce(region, '') AS employer, sum(w) AS a, sum(CASE WHEN channel = 'BUILDING' THEN w ELSE 0 END) AS h, count(*) FILTER (WHERE channel = 'BUILDING') AS taken FROM posting WHERE month(day) = 12 GROUP BY 1, 2)"""


@query(CELLS + """, t AS (SELECT period, sum(a) AS ta, sum(h) AS th, count(*) FILTER (WHERE taken > 0) AS employers FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY h DESC, employer) AS rank FROM c WHERE taken > 0),
x AS (SELECT period, sum(h) FILTER (WHERE rank <= 1) AS one, sum(h) FILTER (WHERE rank <= 5) AS five FROM r GROUP BY 1)
SELECT period, rank, employer, taken, round(h / th, 6) AS share_of_hits, round(a / ta, 6) AS share_of_all, round(th / ta, 6) AS hit_share, employers, round(one / th, 6) AS top1, round(five / th, 6) AS top5 FROM r JOIN t USING (period) JOIN x USING (period) WHERE rank <= 15""")
def p9_employers(spark, d):
    """Each December's regions, in the place of employers."""
    rows = postings(spark, d).where(F.month("day") == 12)
    return rounded(K.employers_behind(rows, F.year("day"), "region", "w", F.expr(HIT)))


@query(CELLS + """, r AS (SELECT *, CASE WHEN h > 0 THEN row_number() OVER (PARTITION BY period ORDER BY h DESC, employer) ELSE 99 END AS rank FROM c)
SELECT period, k AS left_out, round(sum(h) FILTER (WHERE rank > k) / sum(a) FILTER (WHERE rank > k), 6) AS share FROM r, (VALUES (0), (1), (3), (5)) AS v(k) GROUP BY 1, 2""")
def p9_without_largest(spark, d):
    rows = postings(spark, d).where(F.month("day") == 12)
    return rounded(K.without_largest(rows, F.year("day"), "region", "w", F.expr(HIT)))


@query(f"""WITH {POSTINGS}, p AS (SELECT day, channel, title, coalesce(region, '') AS opening FROM posting WHERE day BETWEEN DATE '1995-12-04' AND DATE '1995-12-17'), n AS (SELECT count(DISTINCT day) AS days, count(*) AS rows, count(channel) AS flagged FROM p),
u AS (SELECT 'channel' AS what, channel AS name FROM p WHERE channel IS NOT NULL UNION ALL SELECT 'title', title FROM p WHERE channel IS NOT NULL UNION ALL SELECT 'opening', opening FROM p WHERE channel IS NOT NULL),
c AS (SELECT what, name, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY n DESC, name) AS rank FROM c)
SELECT 'total' AS what, 'days' AS name, days AS n, NULL::DOUBLE AS share FROM n UNION ALL SELECT 'total', 'rows', rows, NULL FROM n UNION ALL SELECT 'total', 'flagged', flagged, round(flagged::DOUBLE / rows, 6) FROM n
UNION ALL SELECT what, name, r.n, round(r.n::DOUBLE / flagged, 6) FROM r, n WHERE what = 'channel' OR rank <= 12""")
def pb18_week_wordings(spark, d):
    return rounded(K.week_inspection(postings(spark, d), "day", "1995-12-04", "1995-12-17", "channel", F.col("title"), F.col("region")))


@query(f"""WITH {POSTINGS}, c AS (SELECT cluster, region, sum(w) AS w, count(*) AS n FROM posting WHERE cluster IN (0, 2, 4, 77) AND day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1, 2),
a AS (SELECT cluster, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (WHERE region IS NOT NULL), 0)::BIGINT AS placed, coalesce(sum(w) FILTER (WHERE region IS NULL), 0) / sum(w) AS unplaced, sum(w) FILTER (WHERE region IS NOT NULL) AS pw FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, region) AS rank FROM c WHERE region IS NOT NULL)
SELECT a.cluster::BIGINT AS cluster, rows, placed, round(unplaced, 6) AS unplaced, rank, region, round(w / pw, 6) AS share FROM a LEFT JOIN r ON r.cluster = a.cluster AND rank <= 3""")
def p14_region_table(spark, d):
    rows = postings(spark, d).where(F.col("day").between("1995-01-01", "1996-12-31"))
    return rounded(K.region_table(rows, "cluster", "region", "w", [0, 2, 4, 77]))


@query(f"""WITH {POSTINGS}, l AS (SELECT 'cluster' AS input, CAST(cluster AS VARCHAR) AS k, count(*) AS size, avg(w) - 2 AS lift FROM posting WHERE cluster >= 0 GROUP BY 2 UNION ALL SELECT 'region', region, count(*), avg(w) - 2 FROM posting WHERE region IS NOT NULL GROUP BY 2),
b AS (SELECT quantile_cont(lift, 0.3) AS cutoff FROM l WHERE input = 'cluster')
SELECT input, count(*) AS clusters, round(quantile_cont(lift, 0.25), 6) AS q1, round(quantile_cont(lift, 0.5), 6) AS median, round(quantile_cont(lift, 0.75), 6) AS q3, round(any_value(cutoff), 6) AS cutoff, count(*) FILTER (WHERE lift < cutoff) AS weak, round(coalesce(sum(size) FILTER (WHERE lift < cutoff), 0)::DOUBLE / sum(size), 6) AS rows_in_weak FROM l, b GROUP BY 1""")
def t17_weak_clusters(spark, d):
    """Two inputs' clusters under one bar; a mean weight stands for the lift, which coherence_lift() gives for vectors."""
    rows = postings(spark, d)
    of = lambda name, c, df: df.groupBy(F.col(c).cast("string").alias("cluster")).agg(F.count("*").alias("size"), (F.avg("w") - 2).alias("lift")).withColumn("input", F.lit(name))
    lifts = of("cluster", "cluster", rows.where("cluster >= 0")).unionByName(of("region", "region", rows.where("region is not null")))
    return rounded(K.weak_clusters(lifts, "cluster", 30.0))
