"""Queries of the board, resampling and graph operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import boards as B
from corpusstat.operators import graph as G
from corpusstat.operators import vectors as V
from corpusstat.operators import resample as R
from corpusstat.plans.queries import TERMS, query, rounded, terms
from corpusstat.sources.readers import table as t

LOW = "greatest(0, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) - 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n))"
HIGH = "least(1, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) + 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n))"


def month():
    return F.date_format("l_shipdate", "yyyy-MM")


def lines(spark, d):
    return t(spark, d, "lineitem")


@query("""
WITH w AS (SELECT CAST(unnest(range(TIMESTAMP '1994-01-01', TIMESTAMP '1996-05-18', INTERVAL 1 month)) AS DATE) AS "begin"), x AS (SELECT "begin", least(CAST("begin" + INTERVAL 1 month - INTERVAL 1 day AS DATE), DATE '1996-05-17') AS "end" FROM w)
SELECT "begin", "end", "end" - "begin" + 1 AS days, count(o_orderkey) AS n FROM x LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN "begin" AND "end" GROUP BY 1, 2, 3""")
def a12_calendar_windows(spark, d):
    days = t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("c"))
    windows = B.calendar_windows(spark, "1994-01-01", "1996-05-17")
    return rounded(windows.join(days, F.col("day").between(F.col("begin"), F.col("end")), "left").groupBy("begin", "end", "days").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")))


@query(f"""
WITH a AS (SELECT o_orderpriority AS unit, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) * 7 AS DOUBLE) AS total FROM orders GROUP BY 1)
SELECT unit, round(k / n * total, 6) AS estimate, round({LOW} * total, 6) AS low, round({HIGH} * total, 6) AS high FROM a""")
def a17_implied_counts(spark, d):
    cells = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"), (7.0 * F.count("*")).alias("total"))
    return rounded(B.implied_counts(cells, "k", "n", "total").select("unit", "estimate", "low", "high"))


@query("""
WITH o AS (SELECT l_partkey, l_suppkey, min(strftime(l_shipdate, '%Y-%m')) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS weighted, count(DISTINCT m) AS months, count(DISTINCT m) < 5 AS sparse FROM o GROUP BY 1""")
def a26_term_coverage(spark, d):
    rows = lines(spark, d).withColumn("w", F.col("l_suppkey"))
    return rounded(B.term_coverage(rows, "l_partkey", "l_suppkey", month(), "w"))


@query("""
WITH a AS (SELECT p_brand AS item, sum(p_retailprice) FILTER (WHERE p_size <= 20) AS x, sum(p_retailprice) FILTER (WHERE p_size > 30) AS y FROM part GROUP BY 1)
SELECT item, round(coalesce(x, 0) / (SELECT sum(x) FROM a), 6) AS small, round(coalesce(y, 0) / (SELECT sum(y) FROM a), 6) AS large FROM a WHERE item NOT IN (SELECT p_brand FROM part WHERE p_partkey <= 5)""")
def a28_candidate_shares(spark, d):
    part = t(spark, d, "part").withColumnRenamed("p_brand", "item")
    known = part.where("p_partkey <= 5").select("item").distinct()
    return rounded(B.candidate_shares(part, "item", "p_retailprice", {"small": F.col("p_size") <= 20, "large": F.col("p_size") > 30}, known))


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS hits, count(*) AS n, round(10000.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem GROUP BY 1")
def a29_rates(spark, d):
    return rounded(B.rates(lines(spark, d), ["l_suppkey"], F.col("l_returnflag") == "R"))


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS rn FROM c)
SELECT o_custkey, min_id, max_id, min_day, max_day, v AS top_value FROM (SELECT o_custkey, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, min(CAST(o_orderdate AS DATE)) AS min_day, max(CAST(o_orderdate AS DATE)) AS max_day FROM orders GROUP BY 1) JOIN r USING (o_custkey) WHERE rn = 1""")
def a30_page_ranges(spark, d):
    rows = t(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return B.page_ranges(rows, ["o_custkey"], "o_orderkey", F.col("day"), "o_orderpriority")


@query("""
WITH c AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS period, CAST(l_linenumber AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT l_suppkey, period, coalesce(sum(n) FILTER (WHERE v = '7'), 0) / sum(n) AS share FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, period ORDER BY n DESC, v) AS rn FROM c)
SELECT l_suppkey, period, round(share::DOUBLE, 6) AS share, v AS top_value, max(CASE WHEN share > 0 THEN period END) OVER (PARTITION BY l_suppkey) AS last_seen FROM m JOIN r USING (l_suppkey, period) WHERE rn = 1""")
def a31_outage(spark, d):
    return rounded(B.outage(lines(spark, d).withColumn("v", F.col("l_linenumber").cast("string")), "l_suppkey", month(), "v", "7"))


@query("""
WITH c AS (SELECT c_mktsegment, CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END AS part, sum(c_custkey) AS w FROM customer GROUP BY 1, 2), u AS (SELECT c_mktsegment, coalesce(sum(w) FILTER (WHERE part IS NULL), 0) / sum(w) AS unplaced, sum(w) FILTER (WHERE part IS NOT NULL) AS placed FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY w DESC, part) AS rank FROM c WHERE part IS NOT NULL)
SELECT c_mktsegment, part::BIGINT AS part, rank, round((w / placed)::DOUBLE, 6) AS share, round(unplaced::DOUBLE, 6) AS unplaced FROM r JOIN u USING (c_mktsegment) WHERE rank <= 4""")
def a36_region_mix(spark, d):
    rows = t(spark, d, "customer").withColumns({"part": F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")), "w": F.col("c_custkey").cast("double")})
    return rounded(B.mix(rows, "c_mktsegment", "part", "w", 4))


@query("""
SELECT year(l_shipdate) AS year, l_returnflag, count(*) AS n, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY year(l_shipdate)), 6) AS share FROM lineitem GROUP BY 1, 2""")
def a38_cross_tab(spark, d):
    return rounded(B.cross_tab(lines(spark, d).withColumn("year", F.year("l_shipdate")), ["year", "l_returnflag"], "l_quantity"))


@query(r"""
WITH f AS (SELECT lang, source, unnest([{'p': 'digits', 'h': regexp_matches(coalesce(text, ''), '[0-9]{4}')}, {'p': 'license', 'h': regexp_matches(coalesce(text, ''), '[Ll]icen[sc]e')}]) AS x FROM documents),
c AS (SELECT x.p AS pattern, lang, source, CAST(count(*) FILTER (WHERE x.h) AS BIGINT) AS hits, count(*) AS n FROM f GROUP BY 1, 2, 3)
SELECT pattern, lang, source, hits, round(hits / n::DOUBLE, 6) AS ratio, CAST(sum(hits) OVER b AS BIGINT) AS board_hits, round((sum(hits) OVER b)::DOUBLE / sum(n) OVER b, 6) AS board_ratio FROM c WINDOW b AS (PARTITION BY pattern, source)""")
def a39_pattern_hits(spark, d):
    return rounded(B.pattern_hits(t(spark, d, "documents"), "lang", "source", "text", {"digits": "[0-9]{4}", "license": "[Ll]icen[sc]e"}))


@query("""
WITH o AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS s FROM lineitem GROUP BY 1), f AS (SELECT o_orderpriority, len(list_intersect(coalesce(s, []), [1, 2, 3, 4, 5, 6, 7, 8])) AS k, o_orderstatus = 'P' AS p FROM orders LEFT JOIN o ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) FILTER (WHERE k >= 1) AS one, count(*) FILTER (WHERE k >= 2) AS two, count(*) FILTER (WHERE p) AS phrase, count(*) FILTER (WHERE p OR k >= 1) AS either FROM f GROUP BY 1""")
def a43_seed_carriers(spark, d):
    items = lines(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("s"))
    rows = t(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return B.carriers(rows, ["o_orderpriority"], F.col("s"), [str(i) for i in range(1, 9)], F.col("o_orderstatus") == "P")


@query("""
SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS flagged, count(*) AS n, round(count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*), 6) AS share FROM lineitem GROUP BY 1
HAVING count(*) FILTER (WHERE l_returnflag = 'R') >= 10 AND count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*) >= 0.3""")
def a44_flagged_groups(spark, d):
    return rounded(B.flagged_groups(lines(spark, d), "l_partkey", F.col("l_returnflag") == "R", 10, 0.3))


@query("""
SELECT l_returnflag, count(*) AS n, round(median(l_discount), 6) AS median, round(avg(CAST(l_discount >= 0.05 AS INT)), 6) AS above, round(avg(CAST(l_linenumber = 1 AS INT)), 6) AS exact FROM lineitem GROUP BY 1""")
def a45_match_statistics(spark, d):
    return rounded(B.match_statistics(lines(spark, d), ["l_returnflag"], "l_discount", F.col("l_linenumber") == 1, 0.05))


@query("SELECT quality::BIGINT AS quality, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS fraction FROM labels GROUP BY 1")
def a46_distribution(spark, d):
    return rounded(B.distribution(t(spark, d, "labels"), "quality"))


@query("""
WITH a AS (SELECT o_orderpriority AS unit, o_orderkey % 3 AS a, o_custkey % 3 AS b, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey + o_custkey) % 3 END AS c FROM orders)
SELECT unit, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a = c) AS first_right, count(*) FILTER (WHERE b = c) AS second_right FROM a WHERE c IS NOT NULL GROUP BY 1""")
def a47_review(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("unit"), (F.col("o_orderkey") % 3).alias("a"), (F.col("o_custkey") % 3).alias("b"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") + F.col("o_custkey")) % 3).alias("c"))
    return B.review(rows, ["unit"], "a", "b", "c")


@query("""
WITH o AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag <> 'R'), []) AS x, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber <= 3), []) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey % 10 AS unit, CAST(sum(len(list_intersect(x, y))) AS BIGINT) AS both, CAST(sum(len(x)) AS BIGINT) AS theirs, round(sum(len(list_intersect(x, y)))::DOUBLE / sum(len(x)), 6) AS share FROM o GROUP BY 1""")
def a48_overlap(spark, d):
    rows = lines(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("x"), F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey"))).alias("y"))
    return rounded(B.overlap(rows.withColumn("unit", F.col("l_orderkey") % 10), ["unit"], F.col("x"), F.col("y")))


@query("""
WITH c AS (SELECT lang, split_part(text, chr(10), 1) AS c, count(*) AS n FROM documents GROUP BY 1, 2), e AS (SELECT lang, count(DISTINCT source) AS employers FROM documents GROUP BY 1)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS wordings, round(max(n)::DOUBLE / sum(n), 6) AS top_share, any_value(employers) AS employers FROM c JOIN e USING (lang) GROUP BY 1""")
def a50_wording(spark, d):
    return rounded(B.wording(t(spark, d, "documents"), ["lang"], F.substring_index("text", "\n", 1), "source"))


@query("""
SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 12""")
def a51_employers_by_period(spark, d):
    return B.employers_by_period(lines(spark, d), "l_suppkey", "l_returnflag", ["A", "N", "R"], 12)


@query(f"""
WITH c AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest({TERMS}) AS word FROM documents) GROUP BY 1), s AS (SELECT *, regexp_replace(word, 's$', '') AS stem FROM c)
SELECT a.word, a.stem, a.n, coalesce(b.n > 1.5 * greatest(a.n, 1), false) AS stemmed FROM s a LEFT JOIN c b ON a.stem = b.word""")
def a52_stemmed(spark, d):
    counts = t(spark, d, "documents").select(F.explode(terms()).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return B.stemmed(counts.withColumn("stem", F.regexp_replace("word", "s$", "")), "word", "stem", "n")


@query(f"""
WITH a AS (SELECT o_orderpriority AS method, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS k FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1), b AS (SELECT *, k / n AS p, {LOW} AS low, {HIGH} AS high FROM a)
SELECT method, CAST(n AS BIGINT) AS n, round(p, 6) AS precision, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN p < 0.48 THEN 'not accepted' WHEN low < 0.48 THEN 'borderline' ELSE 'accepted' END AS decision FROM b""")
def e26_matcher_precision(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus") == "F").alias("right"))
    out = B.matcher_precision(rows, "method", "right")
    return rounded(out.withColumn("decision", B.decision(F.col("precision"), F.col("low"), 0.48)))  # E23


@query("""
WITH w AS (SELECT strftime(o_orderdate, '%Y') AS period, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), g AS (SELECT *, n - avg(n) OVER (PARTITION BY period) AS gap FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round(abs(gap), 9) DESC, week) AS rank FROM g) SELECT period, week, round(gap, 6) AS gap, rank FROM r WHERE rank <= 3""")
def e21_weekly_outliers(spark, d):
    weeks = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("period"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count("*").cast("double").alias("n"))
    return rounded(B.weekly_outliers(weeks, "period", "week", "n", 3))


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag AS rule, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_quantity > 25), []) AS x, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_discount > 0.08), []) AS y FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_suppkey, rule, CASE WHEN len(x) + len(y) > 0 THEN 2 * len(list_intersect(x, y))::DOUBLE / (len(x) + len(y)) ELSE 0 END AS f1 FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY f1 DESC, rule) AS rn FROM f)
SELECT l_suppkey, rule, round(f1, 6) AS f1 FROM r WHERE rn = 1""")
def e25_best_rules(spark, d):
    rows = lines(spark, d).groupBy("l_suppkey", F.col("l_returnflag").alias("rule")).agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("x"), F.collect_set(F.when(F.col("l_discount") > 0.08, F.col("l_linenumber"))).alias("y"))
    return rounded(B.best_rules(rows, "l_suppkey", "rule", F.col("x"), F.col("y")))


def drawn(keys: str) -> str:
    """SQL of the number of times that a unit is drawn."""
    u = f"(CAST('0x' || substr(md5('1|' || {keys}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    return "(" + " + ".join(f"CAST({u} >= {p!r}::DOUBLE AS INT)" for p in R.POISSON) + ")"


WEEKS = "SELECT o_orderpriority AS unit, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS b FROM orders GROUP BY 1, 2"


@query(f"""
WITH w AS ({WEEKS}), d AS (SELECT unit, r, t, b, {drawn("r || '|' || week")} AS k FROM w, range(1, 1001) AS x(r)), e AS (SELECT unit, r, sum(k * t) / nullif(sum(k * b), 0) AS v FROM d GROUP BY 1, 2)
SELECT unit, round(ratio, 6) AS ratio, count(v) AS defined, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM e JOIN (SELECT unit, sum(t) / sum(b) AS ratio FROM w GROUP BY 1) USING (unit) GROUP BY 1, 2""")
def e8_week_interval(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("unit"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("hit"))
    return rounded(R.ratio_interval(rows, ["unit"], ["week"], F.col("hit"), F.lit(1.0)))


@query(f"""
WITH w AS ({WEEKS}), s AS (SELECT *, week >= DATE '1995-01-02' AS late FROM w), d AS (SELECT unit, r, late, t, b, {drawn("r || '|' || week || '|' || late")} AS k FROM s, range(1, 1001) AS x(r)),
e AS (SELECT unit, r, sum(k * t) FILTER (WHERE late) / nullif(sum(k * b) FILTER (WHERE late), 0) - sum(k * t) FILTER (WHERE NOT late) / nullif(sum(k * b) FILTER (WHERE NOT late), 0) AS v FROM d WHERE k > 0 GROUP BY 1, 2),
p AS (SELECT unit, sum(t) FILTER (WHERE late) / sum(b) FILTER (WHERE late) - sum(t) FILTER (WHERE NOT late) / sum(b) FILTER (WHERE NOT late) AS difference FROM s GROUP BY 1)
SELECT unit, round(difference, 6) AS difference, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM e JOIN p USING (unit) GROUP BY 1, 2""")
def e9_difference_interval(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("unit"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("hit"))
    return rounded(R.difference_interval(rows, ["unit"], ["week"], F.col("week") >= F.to_date(F.lit("1995-01-02")), F.col("hit"), F.lit(1.0)))


@query(f"""
WITH w AS ({WEEKS}), s AS (SELECT *, week >= DATE '1995-01-02' AS late, count(*) FILTER (WHERE week >= DATE '1995-01-02') OVER (PARTITION BY unit) AS n FROM w),
r AS (SELECT *, CASE WHEN r = 0 THEN late ELSE row_number() OVER (PARTITION BY unit, r ORDER BY md5('1|' || r || '|' || week)[1:8], week) <= n END AS ins FROM s, range(0, 1001) AS x(r)),
e AS (SELECT unit, r, round(abs(sum(t) FILTER (WHERE ins) / sum(b) FILTER (WHERE ins) - sum(t) FILTER (WHERE NOT ins) / sum(b) FILTER (WHERE NOT ins)), 12) AS d FROM r GROUP BY 1, 2)
SELECT unit, round(any_value(o.d), 6) AS distance, round(avg(CAST(e.d >= o.d AS INT)) + 1 / 1000.0::DOUBLE, 6) AS p FROM e JOIN (SELECT unit, d FROM e WHERE r = 0) o USING (unit) WHERE r > 0 GROUP BY 1""")
def e14_permutation(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week")).agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("t"), F.count("*").cast("double").alias("b"))
    return rounded(R.permutation_null(rows, ["unit"], "week", F.col("week") >= F.to_date(F.lit("1995-01-02")), "t", "b"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)) SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def t7_tf_idf(spark, d):
    return rounded(G.tf_idf(t(spark, d, "documents"), "doc_id", terms(), 5))


def edges(spark, d):
    return G.heat_edges(V.neighbour_graph(t(spark, d, "embeddings"), "vec_id", "embedding", 10), "query", "neighbour", "cosine")


@query()
def t10_heat_edges(spark, d):
    """Every vector's neighbours; held against brute force on a small fixture, with the recall of the cells."""
    return rounded(edges(spark, d))


@query()
def t11_laplacian_scores(spark, d):
    return rounded(G.laplacian_scores(edges(spark, d), t(spark, d, "embeddings"), "vec_id", "label"))
