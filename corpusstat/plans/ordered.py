"""Queries of the ordered operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.functions import text as X
from corpusstat.operators import ordered as O
from corpusstat.plans.queries import query, rounded
from corpusstat.sources.readers import table as t

DAYS = "SELECT o_orderpriority AS unit, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2"


def order_days(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT l_shipmonth AS period, unit, k, sum(k) OVER (PARTITION BY l_shipmonth) AS n FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, 'S' || (l_suppkey % 8) AS unit, CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY 1, 2)),
b AS (SELECT unit, period, greatest(0, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) - 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n)) AS low, least(1, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) + 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n)) AS high FROM a),
c AS (SELECT *, coalesce(max(low) OVER (PARTITION BY unit ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0.12, false) AS was FROM b)
SELECT period, count(*) FILTER (WHERE was) AS above_before, count(*) FILTER (WHERE was AND high < 0.12) AS dips, count(*) FILTER (WHERE was AND high < 0.12) >= 2 AND count(*) FILTER (WHERE was AND high < 0.12) >= 0.3 * count(*) FILTER (WHERE was) AS joint FROM c GROUP BY 1""")
def w5_joint_dips(spark, d):
    df = t(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey") % 8).alias("unit"), F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("k"))
    df = df.join(df.groupBy("period").agg(F.sum("k").alias("n")), "period")
    low, high = X.wilson(F.col("k"), F.col("n"))
    return O.joint_dips(df.select("unit", "period", low.alias("low"), high.alias("high")), "unit", "period", "low", "high", 0.12, least=2)


@query(f"""
WITH d AS ({DAYS}), a AS (SELECT *, avg(n) OVER b AS before, avg(n) OVER f AS after, count(*) OVER b + count(*) OVER f AS c, date_diff('day', min(day) OVER b, max(day) OVER f) AS span FROM d
  WINDOW b AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT unit, day, round(before, 6) AS before, round(after, 6) AS after, round(after / before, 6) AS ratio FROM a WHERE c = 14 AND span <= 20""")
def w7_jump_candidates(spark, d):
    return rounded(O.jump_candidates(order_days(spark, d), "unit", "day", "n", 7))


@query(f"""
WITH d AS ({DAYS}), a AS (SELECT *, count(*) OVER (PARTITION BY unit) AS c, row_number() OVER (PARTITION BY unit ORDER BY n, day) AS rn FROM d)
SELECT unit, day, n, CASE WHEN rn <= c // 3 THEN 'low' WHEN rn > c - c // 3 THEN 'high' ELSE 'middle' END AS third FROM a""")
def w9_volume_thirds(spark, d):
    return O.volume_thirds(order_days(spark, d), ["unit"], "day", "n")


@query("""
WITH a AS (SELECT o_orderpriority AS unit, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT unit, period, n, lag(n) OVER w AS before, n - lag(n) OVER w AS change FROM a WINDOW w AS (PARTITION BY unit ORDER BY period)""")
def w10_transitions(spark, d):
    df = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))
    return O.transitions(df, "unit", "period", "n")


@query("""
WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, lag(CAST(o_orderdate AS DATE)) OVER w AS before, o_custkey, lag(o_custkey) OVER w AS page FROM orders WINDOW w AS (ORDER BY o_orderkey))
SELECT o_orderkey, day, before FROM a WHERE page <> o_custkey AND day < before""")
def w11_clock_breaks(spark, d):
    return O.clock_breaks(t(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")), "o_orderkey", "o_custkey", "day", 1000)


@query("""SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, round(CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY p_brand), 6) AS below FROM part""")
def w12_share_below(spark, d):
    return rounded(O.share_below(t(spark, d, "part"), "p_brand", "p_partkey", "p_size"))


@query("""
WITH a AS (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY c DESC, l_partkey) AS rank FROM a), e AS (SELECT count(*) AS n, min(c) AS lo, max(c) AS hi FROM a),
g AS (SELECT c, rank, round(1 - CAST(rank - 1 AS DOUBLE) / (n - 1) - CAST(c - lo AS DOUBLE) / (hi - lo), 12) AS gap FROM r, e)
SELECT rank, c AS count FROM g ORDER BY gap DESC, rank LIMIT 1""")
def w15_knee(spark, d):
    return O.knee(t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c")), "c")


@query("""
WITH a AS (SELECT o_orderpriority AS unit, count(*) AS pages FROM orders GROUP BY 1), b AS (SELECT unit, pages, unnest(range(0, 12)) AS j FROM a)
SELECT DISTINCT unit, pages, greatest(1, least(pages, CAST(round_even((j + 0.5::DOUBLE) * pages / 12, 0) AS BIGINT))) AS page FROM b""")
def s2_grid(spark, d):
    return O.grid(t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit")).agg(F.count("*").alias("pages")), "pages", 12)


@query("""
WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_brand, p_partkey, turn FROM a ORDER BY turn, p_brand LIMIT 60""")
def s6_round_robin(spark, d):
    return rounded(O.round_robin(t(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 60))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS w FROM lineitem), c AS (SELECT *, least(w, (SELECT quantile_cont(w, 0.95) FROM a)) AS x FROM a)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(x * (SELECT sum(w) / sum(x) FROM c), 6) AS w FROM c""")
def a20_capped_weights(spark, d):
    return rounded(O.rescaled(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w")), "w", "cap"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, ln(1 + l_quantity) AS x FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(x * (SELECT sum(w) / sum(x) FROM a), 6) AS w FROM a""")
def a20_log_weights(spark, d):
    return rounded(O.rescaled(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w")), "w", "log"))


@query("""
WITH a AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2), b AS (SELECT day, sum(n) ** 2 / sum(n * n) AS e FROM a GROUP BY 1)
SELECT count(*) AS days, round(quantile_cont(e, 0.1), 6) AS p10, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90 FROM b""")
def a24_daily_effective(spark, d):
    return rounded(O.daily_effective(t(spark, d, "lineitem"), F.to_date("l_shipdate"), "l_suppkey"))


HIT, LATER = "l_returnflag = 'R'", "year(l_shipdate) >= 1994"


@query(f"""
WITH a AS (SELECT sum(l_quantity) FILTER (WHERE {LATER}) AS ta, sum(l_quantity) FILTER (WHERE NOT {LATER}) AS tb FROM lineitem)
SELECT l_suppkey, round(coalesce(sum(l_quantity) FILTER (WHERE {HIT} AND {LATER}), 0) / any_value(ta) - coalesce(sum(l_quantity) FILTER (WHERE {HIT} AND NOT {LATER}), 0) / any_value(tb), 9) AS contribution FROM lineitem, a GROUP BY 1""")
def a34_contributions(spark, d):
    out = O.contributions(t(spark, d, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", F.year("l_shipdate") >= 1994, "l_quantity")
    return out.select("l_suppkey", F.round("contribution", 9).alias("contribution"))


@query(f"""
WITH a AS (SELECT l_suppkey, sum(l_quantity) AS x, coalesce(sum(l_quantity) FILTER (WHERE {HIT}), 0) AS h FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY h DESC, l_suppkey) AS rn FROM a), k(k) AS (VALUES (0), (1), (3), (5))
SELECT CAST(k AS BIGINT) AS k, round(sum(h) / sum(x), 6) AS share FROM r, k WHERE rn > k GROUP BY 1""")
def a35_leave_out(spark, d):
    return rounded(O.leave_out(t(spark, d, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", "l_quantity"))


@query("""
WITH a AS (SELECT p_brand, p_size, sum(p_retailprice) AS s FROM part GROUP BY 1, 2), b AS (SELECT p_brand, p_size, 2 * sum(s) OVER (PARTITION BY p_brand ORDER BY p_size) >= sum(s) OVER (PARTITION BY p_brand) AS half FROM a)
SELECT p_brand, CAST(min(p_size) AS BIGINT) AS median FROM b WHERE half GROUP BY 1""")
def a53_weighted_median(spark, d):
    return rounded(O.weighted_median(t(spark, d, "part"), "p_brand", "p_size", "p_retailprice"))


@query("""
WITH k AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 3) SELECT CASE WHEN p_type IN (FROM k) THEN p_type ELSE '(other)' END AS p_type, count(*) AS n FROM part GROUP BY 1""")
def a49_collapse_rare(spark, d):
    return O.collapse_rare(t(spark, d, "part").select("p_type"), "p_type", 3).groupBy("p_type").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS m, count(*) FILTER (WHERE day(o_orderdate) > 1) AS n FROM orders GROUP BY 1)
SELECT month, n AS days_total, m AS month_total, abs(n - m) > 0.02 * m AS differs FROM a WHERE n > 0""")
def e22_count_check(spark, d):
    orders = t(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    days = orders.where(F.dayofmonth("o_orderdate") > 1).groupBy("month", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return O.count_check(days, orders.groupBy("month").agg(F.count("*").alias("n")), "month", "n")


@query("""
WITH c AS (SELECT l_returnflag, l_linenumber, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY l_returnflag)), s AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY l_linenumber)), b AS (SELECT sum(n * (n - 1) / 2) AS b, sum(n) AS n FROM c)
SELECT round((b - r * s / (n * (n - 1) / 2)) / ((r + s) / 2 - r * s / (n * (n - 1) / 2)), 6) AS ari FROM b, r, s""")
def t23_rand_index(spark, d):
    return rounded(O.rand_index(t(spark, d, "lineitem"), "l_returnflag", "l_linenumber"))
