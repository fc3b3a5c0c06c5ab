"""Registered queries: each applies an operator to the driver's tables, with the SQL that checks it. Doubles are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.functions import text as X
from corpusstat.operators import corpus as C
from corpusstat.operators import estimate as S
from corpusstat.operators import mining as M
from corpusstat.operators import vectors as V
from corpusstat.operators.ordered import percentile_of
from corpusstat.sources.readers import table as t

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes))


NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g'))"


#: A text's first line, as its title.
FIRST = NORM.replace("coalesce(text, '')", "split_part(coalesce(text, ''), chr(10), 1)")


def first_line():
    return X.norm_words(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))


@query(rf"""
WITH a AS (SELECT doc_id, source, md5({NORM}) AS k FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, doc_id) AS rn FROM a),
c AS (SELECT doc_id, source FROM b WHERE rn = 1), d AS (SELECT source, count(*) AS total FROM documents GROUP BY 1), e AS (SELECT source, count(*) AS taken FROM c GROUP BY 1)
SELECT doc_id, source, round(CAST(total AS DOUBLE) / taken, 6) AS w FROM c JOIN d USING (source) JOIN e USING (source)""")
def dd1_weighted_corpus(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    total = docs.groupBy("source").agg(F.count("*").alias("total"))
    return rounded(C.weighted_corpus(docs.join(F.broadcast(total), "source"), "text", "source", "total", ["doc_id"]).select("doc_id", "source", "w"))


WEIGHTED = """SELECT *, CAST(date_part('day', ts) AS DOUBLE) AS w FROM events"""


def weighted_events(spark, d):
    return t(spark, d, "events").withColumn("w", F.dayofmonth("ts").cast("double"))


@query("""
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS category, o_totalprice AS w, CAST(o_orderdate AS DATE) AS day FROM orders),
b AS (SELECT month, count(*) AS n, count(*) FILTER (WHERE category = '1-URGENT') AS k, sum(CASE WHEN category = '1-URGENT' THEN w ELSE 0 END) / sum(w) AS share FROM a GROUP BY 1)
SELECT month, n, round(share, 6) AS share, round(greatest(0, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) - 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n)), 6) AS low,
       round(least(1, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) + 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n)), 6) AS high
FROM (SELECT month, CAST(n AS BIGINT) AS n, CAST(k AS DOUBLE) AS k, share FROM b)""")
def a14_monthly_shares(spark, d):
    """The flagship: weighted share of urgent orders by month with Wilson bounds."""
    hit = F.col("o_orderpriority") == "1-URGENT"
    df = t(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    df = df.groupBy("month").agg((F.sum(F.when(hit, F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice")).alias("share"), F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return rounded(df.select("month", "n", "share", low.alias("low"), high.alias("high")))


@query("""
WITH e(event, start) AS (VALUES ('A', DATE '1996-03-01'), ('B', DATE '1996-03-20')),
a AS (SELECT event, CASE WHEN CAST(o_orderdate AS DATE) < start THEN 'before' ELSE 'after' END AS side, o_orderpriority = '1-URGENT' AS hit, o_totalprice AS w FROM orders, e
      WHERE date_diff('day', start, CAST(o_orderdate AS DATE)) >= -45 AND date_diff('day', start, CAST(o_orderdate AS DATE)) < 45)
SELECT event, side, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS share, count(*) AS n FROM a GROUP BY 1, 2""")
def a15_event_windows(spark, d):
    return rounded(S.event_shares(t(spark, d, "orders"), "o_orderdate", F.col("o_orderpriority") == "1-URGENT", "o_totalprice", [("A", "1996-03-01"), ("B", "1996-03-20")], 45))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def a16_day_categories(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH a AS (SELECT o_orderpriority AS series, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, o_totalprice AS w, year(o_orderdate) = 1995 AS base FROM orders),
b AS (SELECT series, period, sum(w) AS x FROM a GROUP BY 1, 2), c AS (SELECT series, sum(w) / (SELECT sum(w) FROM a WHERE base) AS s0 FROM a WHERE base GROUP BY 1)
SELECT series, period, round(x / sum(x) OVER (PARTITION BY period), 6) AS share, round(x / sum(x) OVER (PARTITION BY period) / s0, 6) AS ssi FROM b LEFT JOIN c USING (series)""")
def a18_surge_index(spark, d):
    df = t(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), X.quarter(F.col("o_orderdate")).alias("period"), F.col("o_totalprice").alias("w"), (F.year("o_orderdate") == 1995).alias("base"))
    return rounded(S.surge(df, "series", "period", F.col("base"), "w"))


@query("""
WITH a AS (SELECT l_returnflag || l_linestatus AS cluster, r_name AS region, sum(l_extendedprice) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
b AS (SELECT *, x / sum(x) OVER (PARTITION BY cluster) AS p, row_number() OVER (PARTITION BY cluster ORDER BY x DESC, region) AS rn FROM a)
SELECT cluster, round(sum(p * p), 6) AS hhi, round(sum(CASE WHEN rn <= 3 THEN p END), 6) AS top_share, count(*) AS units, round(1 / sum(p * p), 6) AS effective, round((sum(p * p) - 0.2) / 0.8, 6) AS hhi_norm FROM b GROUP BY 1""")
def a21_region_hhi(spark, d):
    places = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("region"))
    df = t(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("cluster")).groupBy("cluster", "l_suppkey").agg(F.sum("l_extendedprice").alias("x"))
    return rounded(S.concentration(df.join(places, F.col("l_suppkey") == F.col("s_suppkey")), ["cluster"], "region", "x", 5))


@query("""
WITH a AS (SELECT p_type AS cluster, l_suppkey AS unit, count(*) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b AS (SELECT *, CAST(x AS DOUBLE) / sum(x) OVER (PARTITION BY cluster) AS p, row_number() OVER (PARTITION BY cluster ORDER BY x DESC, unit) AS rn FROM a)
SELECT cluster, round(sum(p * p), 6) AS hhi, round(sum(CASE WHEN rn <= 3 THEN p END), 6) AS top_share, count(*) AS units, round(1 / sum(p * p), 6) AS effective FROM b GROUP BY 1""")
def a23_employer_concentration(spark, d):
    parts = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("cluster"))
    df = t(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("unit"), F.lit(1).alias("x")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(S.concentration(df, ["cluster"], "unit", "x"))


@query("""
WITH a AS (SELECT DISTINCT o_orderkey, o_orderpriority AS channel, o_totalprice AS w, p_brand AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
b AS (SELECT item, channel, count(*) AS n, sum(w) AS x FROM a GROUP BY 1, 2)
SELECT item, channel, n, round(x / xg / (xi / xa), 6) AS lift FROM b JOIN (SELECT item, sum(x) AS xi FROM b GROUP BY 1) USING (item) JOIN (SELECT channel, sum(x) AS xg FROM b GROUP BY 1) USING (channel), (SELECT sum(x) AS xa FROM b) WHERE n >= 5""")
def a25_skill_lift(spark, d):
    items = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item")), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "item").distinct()
    df = items.join(t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("w")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(S.lift(df, "item", "channel", "w", 5))


@query("""
WITH a AS (SELECT source, coalesce(100.0 * count(*) FILTER (WHERE NOT (text IS NULL OR trim(text) = '' OR lower(trim(text)) = 'empty')) / count(*), 0) AS text, 100.0 * count(*) FILTER (WHERE NOT (lang IS NULL OR trim(lang) = '' OR lower(trim(lang)) = 'empty')) / count(*) AS lang FROM documents GROUP BY 1)
SELECT source, 'text' AS field, round(text, 6) AS percent FROM a UNION ALL SELECT source, 'lang', round(lang, 6) FROM a""")
def a1_completeness(spark, d):
    return rounded(C.completeness(t(spark, d, "documents"), ["text", "lang"], "source"))


@query("SELECT event_type, count(*) FILTER (WHERE day(ts) = 1) AS n_1, count(*) FILTER (WHERE day(ts) = 2) AS n_2, count(*) FILTER (WHERE day(ts) = 3) AS n_3 FROM events GROUP BY 1")
def a5_crosstab(spark, d):
    return rounded(C.crosstab(t(spark, d, "events"), "event_type", F.dayofmonth("ts"), [1, 2, 3]))


@query("""WITH a AS (SELECT p_type, count(*) AS n FROM part WHERE NOT (p_type IS NULL OR trim(p_type) = '' OR lower(trim(p_type)) = 'empty') GROUP BY 1)
SELECT p_type, n, round(100.0 * n / (SELECT sum(n) FROM a), 6) AS percent FROM a ORDER BY n DESC, p_type LIMIT 5""")
def a6_top_values(spark, d):
    return rounded(C.top_values(t(spark, d, "part"), "p_type", 5))


@query("""
WITH y(y) AS (SELECT unnest(range(1995, 2002))), a AS (SELECT o_orderpriority AS unit, y AS point, count(*) AS n FROM orders, y WHERE year(o_orderdate) >= y GROUP BY 1, 2)
SELECT unit, point, n, n - lead(n) OVER w AS "between", n < lead(n) OVER w AS negative FROM a WINDOW w AS (PARTITION BY unit ORDER BY point)""")
def a11_interval_counts(spark, d):
    years = F.explode(F.sequence(F.lit(1995).cast("bigint"), F.least(F.year("o_orderdate"), F.lit(2001)).cast("bigint")))
    since = t(spark, d, "orders").select(F.col("o_orderpriority").alias("unit"), years.alias("point")).groupBy("unit", "point").agg(F.count("*").alias("n"))
    return C.interval_counts(since, "unit", "point", "n")


@query(rf"""WITH a AS (SELECT source, md5({NORM}) AS k FROM documents), b AS (SELECT source, k, count(*) AS n FROM a GROUP BY 1, 2)
SELECT source, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) AS keys FROM b GROUP BY 1""")
def dd5_repeats(spark, d):
    return C.repeats(t(spark, d, "documents"), F.md5(X.norm_words(F.coalesce("text", F.lit("")))), "source")


@query(rf"""WITH a AS (SELECT DISTINCT source, md5({NORM}) AS k FROM documents)
SELECT x.source AS a, y.source AS b, count(*) AS shared FROM a x JOIN a y ON x.k = y.k AND x.source < y.source GROUP BY 1, 2""")
def j12_shared_keys(spark, d):
    return C.shared_keys(t(spark, d, "documents"), F.md5(X.norm_words(F.coalesce("text", F.lit("")))), "source")


@query(rf"""WITH a AS (SELECT lang, {NORM.replace("coalesce(text, '')", "substr(coalesce(text, ''), 1, 80)")} AS s, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS top_share, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1""")
def dd6_templates(spark, d):
    return rounded(C.top_template(t(spark, d, "documents"), "text", "lang"))


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 HAVING min(l_returnflag) = max(l_returnflag)")
def a42_unambiguous(spark, d):
    return rounded(C.keep_unambiguous(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag"))


@query("""
WITH a AS (SELECT l_returnflag || l_linestatus AS unit, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, sum(k) OVER (PARTITION BY period) AS n FROM a), c AS (SELECT unit, period, k / n AS share,
  greatest(0, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) - 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n)) AS low, least(1, (k/n + 3.8416/(2*n))/(1 + 3.8416/n) + 1.96*sqrt((k/n)*(1 - k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n)) AS high FROM b)
SELECT unit, period, round(share, 6) AS share, round(low, 6) AS low, round(high, 6) AS high, min(CASE WHEN share >= 0.25 THEN period END) OVER (PARTITION BY unit) AS first_above,
  low >= 0.25 AND max(high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.25 AS clearly_new,
  share >= 0.25 AND lag(share) OVER w < 0.25 AND max(share) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0.25 AS returning,
  count(CASE WHEN low >= 0.25 THEN 1 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_above FROM c WINDOW w AS (PARTITION BY unit ORDER BY period)""")
def w1_emergence(spark, d):
    df = t(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("unit"), X.quarter(F.col("l_shipdate")).alias("period")).agg(F.count("*").alias("k"))
    df = df.withColumn("n", F.sum("k").over(W.partitionBy("period")))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return rounded(S.emergence(df.select("unit", "period", (F.col("k") / F.col("n")).alias("share"), low.alias("low"), high.alias("high")), "unit", "period", "share", "low", "high", 0.25))


@query("""
WITH a AS (SELECT event_type, count(*) FILTER (WHERE day(ts) <= 15) AS a, count(*) FILTER (WHERE day(ts) > 15) AS b FROM events GROUP BY 1), b AS (SELECT CAST(a AS DOUBLE) / sum(a) OVER () AS p, CAST(b AS DOUBLE) / sum(b) OVER () AS q FROM a)
SELECT round((sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2, 6) AS js, round(sum(abs(p - q)) / 2, 6) AS tv FROM b""")
def e13_divergence(spark, d):
    return rounded(S.divergence(t(spark, d, "events"), "event_type", F.dayofmonth("ts") <= 15))


@query("""
WITH a AS (SELECT l_quantity, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)
SELECT round(max(d), 6) AS ks FROM (SELECT abs(CAST(sum(a) OVER (ORDER BY l_quantity) AS DOUBLE) / (SELECT sum(a) FROM a) - CAST(sum(b) OVER (ORDER BY l_quantity) AS DOUBLE) / (SELECT sum(b) FROM a)) AS d FROM a)""")
def e17_ks(spark, d):
    return rounded(S.ks(t(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R"))


LABELS = "SELECT quality AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS said, (1 + doc_id % 5)::DOUBLE AS w FROM labels JOIN documents USING (doc_id)"


def judged(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("truth"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("said"), (1 + F.col("doc_id") % 5).cast("double").alias("w"))


@query(f"""
WITH a AS ({LABELS}), l AS (SELECT truth AS label FROM a UNION SELECT said FROM a),
b AS (SELECT label, (SELECT coalesce(sum(w), 0) FROM a WHERE said = label) AS p, (SELECT coalesce(sum(w), 0) FROM a WHERE truth = label) AS t, (SELECT coalesce(sum(w), 0) FROM a WHERE said = label AND truth = label) AS tp FROM l)
SELECT CAST(label AS BIGINT) AS label, round(CASE WHEN p > 0 THEN tp / p END, 6) AS precision, round(CASE WHEN t > 0 THEN tp / t END, 6) AS recall, round(CASE WHEN t > 0 THEN 2 * tp / (p + t) END, 6) AS f1 FROM b""")
def e1_precision_recall(spark, d):
    return rounded(S.precision_recall(judged(spark, d), "truth", "said", "w"))


@query(f"""
WITH a AS ({LABELS}), c AS (SELECT truth, said, sum(w) AS x FROM a GROUP BY 1, 2), r AS (SELECT truth, sum(x) AS r FROM c GROUP BY 1), s AS (SELECT said, sum(x) AS s FROM c GROUP BY 1)
SELECT round(1 - (SELECT sum(x) FROM c WHERE truth <> said) * (SELECT sum(x) FROM c) / (SELECT sum(r * s) FROM r, s WHERE truth <> said), 6) AS kappa""")
def e4_cohen_kappa(spark, d):
    return rounded(S.agreement(judged(spark, d), "truth", "said", "w"))


@query("""
WITH a AS (SELECT ntile AS truth, least(3, greatest(1, 1 + CAST(floor(l_discount * 30) AS INT))) AS said, l_quantity AS w FROM (SELECT *, 1 + l_linenumber % 3 AS ntile FROM lineitem)),
c AS (SELECT truth, said, sum(w)::DOUBLE AS x FROM a GROUP BY 1, 2), r AS (SELECT truth, sum(x) AS r FROM c GROUP BY 1), s AS (SELECT said, sum(x) AS s FROM c GROUP BY 1)
SELECT round(1 - (SELECT sum(x * (truth - said) ** 2) FROM c) * (SELECT sum(x) FROM c) / (SELECT sum(r * s * (truth - said) ** 2) FROM r, s), 6) AS kappa""")
def e3_weighted_kappa(spark, d):
    df = t(spark, d, "lineitem").select((1 + F.col("l_linenumber") % 3).alias("truth"), F.least(F.lit(3), F.greatest(F.lit(1), 1 + F.floor(F.col("l_discount") * 30).cast("int"))).alias("said"), F.col("l_quantity").alias("w"))
    return rounded(S.agreement(df, "truth", "said", "w", 3))


TERMS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}')"


def terms():
    return F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))


@query(f"""
WITH s AS (SELECT count(*) FILTER (WHERE lang = 'en') AS na, count(*) FILTER (WHERE lang <> 'en') AS nb FROM documents), w AS (SELECT lang = 'en' AS f, unnest(list_distinct({TERMS})) AS term FROM documents),
c AS (SELECT term, count(*) FILTER (WHERE f) AS a, count(*) FILTER (WHERE NOT f) AS b FROM w GROUP BY 1)
SELECT term, a, b, round((ln((a + 0.5::DOUBLE) / (na - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (nb - b + 0.5::DOUBLE))) / sqrt(1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE)), 6) AS z FROM c, s""")
def t2_log_odds(spark, d):
    return rounded(M.log_odds(t(spark, d, "documents"), "doc_id", terms(), F.col("lang") == "en"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(sum(1 + ln(tf)) / any_value(n) * (ln((any_value(n) + 1) / (count(*) + 1)) + 1), 6) AS weight FROM c, n GROUP BY 1""")
def t3_tf_idf(spark, d):
    return rounded(M.tf_idf(t(spark, d, "documents"), "doc_id", terms()))


@query(f"""
WITH w AS (SELECT lang, unnest({TERMS}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2), f AS (SELECT term, sum(n) AS f FROM c GROUP BY 1), m AS (SELECT avg(t) AS m FROM (SELECT sum(n) AS t FROM c GROUP BY lang)),
s AS (SELECT lang, term, n, round(n * ln(1 + m / f), 6) AS score FROM c JOIN f USING (term), m), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""")
def t14_class_tf_idf(spark, d):
    return rounded(M.class_tf_idf(t(spark, d, "documents"), "lang", terms(), 10))


@query("""WITH a AS (SELECT p_type, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part) AS s FROM part GROUP BY 1), q AS (SELECT quantile_cont(log10(s), 0.25) AS a, quantile_cont(log10(s), 0.75) AS b FROM a)
SELECT round(10 ** (b + 1.5 * (b - a)), 6) AS fence FROM q""")
def t12_tukey_fence(spark, d):
    part = t(spark, d, "part")
    shares = part.groupBy("p_type").agg(F.count("*").alias("n")).join(F.broadcast(part.agg(F.count("*").alias("all")))).select((F.col("n") / F.col("all")).alias("s"))
    return rounded(M.upper_fence(shares, "s"))


@query("""
WITH p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM p) SELECT * FROM k WHERE rank <= 10""")
def j11_nearest(spark, d):
    rows = t(spark, d, "embeddings")
    return rounded(V.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10))


LEXICON = [("der die", "de"), ("the", "en"), ("al-lo", "en"), ("erea", "sv"), ("data - base", "en"), (" et ", "fr")]


@query(r"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), b(term, rx) AS (VALUES ('der die', 'der[-\s]+die(?:e?s)?'), ('the', 'the(?:e?s)?'), ('al-lo', 'al[-\s]?lo(?:e?s)?'), ('erea', 'erea[\p{L}\p{M}\p{N}_]*'), ('data - base', 'data[-\s]?base(?:e?s)?'), (' et ', 'et(?:e?s)?'))
SELECT doc_id, list_filter(['der die', 'the', 'al-lo', 'erea', 'data - base', ' et '], lambda x: list_contains(f, x)) AS terms FROM (SELECT doc_id, list(term) FILTER (WHERE regexp_matches(t, '(^|[^\p{L}\p{M}\p{N}_])(?:' || rx || ')($|[^\p{L}\p{M}\p{N}_])')) AS f FROM a, b GROUP BY 1)""")
def x5_lexicon_flags(spark, d):
    """Terms with blanks, hyphens, a run of both, blanks around, and a Swedish ending."""
    df = t(spark, d, "documents").select("doc_id", X.flag(F.coalesce("text", F.lit("")), LEXICON).alias("terms"))
    return df.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


@query("SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, count(*) AS n FROM events GROUP BY 1")
def x34_iso_weeks(spark, d):
    return t(spark, d, "events").groupBy(X.iso_week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


OWN = M.own_words(M.STOP_WORDS)
COUNTS = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(map(repr, ws))}))), 'l': '{lang}'}}" for lang, ws in OWN.items())


@query(f"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM documents), b AS (SELECT doc_id, list_reverse_sort([{COUNTS}]) AS c FROM a)
SELECT doc_id, CASE WHEN c[1].n >= 5 AND c[1].n > 2 * c[2].n THEN c[1].l ELSE 'unclear' END AS language, c[1].n AS hits FROM b""")
def x18_language(spark, d):
    return rounded(M.language(t(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit(""))))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST('0x' || substr(md5('1|' || o_orderkey), 1, 8) AS BIGINT), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, round(n / least(n, 20), 6) AS w FROM r WHERE r <= 20""")
def s4_stratified(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.lit(1.0).alias("w"))
    return rounded(C.stratified(df, ["o_orderpriority"], "o_orderkey", 20, "w"))


@query(rf"""WITH a AS (SELECT source, lang, {FIRST} AS v FROM documents), b AS (SELECT source, v, count(*) AS n FROM a WHERE v IS NOT NULL GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS n, round(1 - count(*) / sum(n), 6) AS repeated FROM b GROUP BY 1""")
def dd7_repeated_share(spark, d):
    return rounded(C.repeated_share(t(spark, d, "documents"), "source", first_line()))


@query(rf"""WITH a AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CASE WHEN {FIRST} <> '' THEN {FIRST} || '|' || source || '|' || lang || '|2024-01-01' END AS fields, CASE WHEN length({NORM}) >= 80 THEN md5(substr({NORM}, 1, 300)) END AS text FROM documents) SELECT doc_id, id, md5(fields) AS fields, text FROM a""")
def dd2_posting_keys(spark, d):
    """With DD3 and DD4."""
    df = t(spark, d, "documents")
    title = first_line()
    keys = C.posting_keys(F.lit(""), F.col("doc_id"), title, F.col("source"), F.col("lang"), F.lit("2024-01-01T10:00:00"), F.col("text"))
    return df.select("doc_id", keys["id"].alias("id"), F.md5(keys["fields"]).alias("fields"), keys["text"].alias("text"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, count(*) AS codes, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS top_share FROM c GROUP BY 1) SELECT * FROM r WHERE codes > 1""")
def a41_ambiguous_names(spark, d):
    return rounded(C.ambiguous_names(t(spark, d, "orders"), "o_custkey", "o_orderpriority"))


@query("""WITH a AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT 'index' AS rule, round(max(v) FILTER (WHERE i = least(floor(0.9 * n), n - 1)), 6) AS percentile FROM a UNION ALL SELECT 'linear', round(quantile_cont(v, 0.9), 6) FROM a UNION ALL SELECT 'nearest', round(max(v) FILTER (WHERE i = round_even(0.9 * (n - 1), 0)), 6) FROM a""")
def x37_percentiles(spark, d):
    df, out = t(spark, d, "lineitem"), None
    for rule in ("index", "linear", "nearest"):
        one = percentile_of(df, "l_extendedprice", 0.9, rule).select(F.lit(rule).alias("rule"), "percentile")
        out = one if out is None else out.union(one)
    return rounded(out)
