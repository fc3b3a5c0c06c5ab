"""Queries of the text mining and profile operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import corpus as C
from corpusstat.operators import mining as M
from corpusstat.operators import vectors as V
from corpusstat.operators import profiles as P
from corpusstat.plans.queries import NORM, TERMS, query, rounded, terms
from corpusstat.sources.readers import table as t

CUT = "[.!?;:,]+"


@query(f"""
WITH s AS (SELECT doc_id, regexp_extract_all(unnest(string_split_regex(lower(coalesce(text, '')), '{CUT}')), '[a-z]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM s, (VALUES (1), (2), (3), (4)) AS v(n) WHERE len(w) >= n)),
f AS (SELECT gram, n, count(*) AS df FROM g GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT gram, df, CAST(n AS BIGINT) AS n FROM f WHERE split_part(gram, ' ', 1) NOT IN ('the', 'of') AND split_part(gram, ' ', n) NOT IN ('the', 'of')""")
def t1_frequent_ngrams(spark, d):
    cut = F.split(F.lower(F.coalesce("text", F.lit(""))), CUT)
    segments = F.transform(cut, lambda s: F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)))
    return rounded(M.frequent_ngrams(t(spark, d, "documents"), segments, 4, 5, ["the", "of"]))


TOPS = f"""w AS (SELECT lang, unnest({TERMS}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2), f AS (SELECT term, sum(n) AS f FROM c GROUP BY 1), m AS (SELECT avg(t) AS m FROM (SELECT sum(n) AS t FROM c GROUP BY lang)),
s AS (SELECT lang, term, round(n * ln(1 + m / f), 6) AS score FROM c JOIN f USING (term), m), tops AS (SELECT lang, term FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS r FROM s) WHERE r <= 6)"""


@query(f"""
WITH {TOPS}, d AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) WHERE term IN (SELECT term FROM tops)), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT term, count(*) AS c FROM d GROUP BY 1), y AS (SELECT p.term AS a, q.term AS b, count(*) AS c FROM d p JOIN d q ON p.doc_id = q.doc_id AND p.term < q.term GROUP BY 1, 2)
SELECT u.lang, u.term AS a, v.term AS b, round(CASE WHEN y.c IS NULL THEN -1.0 WHEN y.c >= n THEN 1.0 ELSE ln((y.c::DOUBLE / n) / (xa.c::DOUBLE / n * xb.c / n)) / -ln(y.c::DOUBLE / n) END, 6) AS npmi
FROM tops u JOIN tops v ON u.lang IS NOT DISTINCT FROM v.lang AND u.lang IS NOT NULL AND u.term < v.term JOIN x xa ON xa.term = u.term JOIN x xb ON xb.term = v.term LEFT JOIN y ON y.a = u.term AND y.b = v.term, n""")
def t15_npmi(spark, d):
    docs = t(spark, d, "documents")
    return rounded(M.npmi(docs, terms(), M.class_tf_idf(docs, "lang", terms(), 6), "lang", "term"))


@query(f"WITH {TOPS} SELECT round(CAST(count(DISTINCT term) AS DOUBLE) / count(*), 6) AS diversity FROM tops")
def t16_diversity(spark, d):
    tops = M.class_tf_idf(t(spark, d, "documents"), "lang", terms(), 6)
    return rounded(tops.agg((F.count_distinct("term") / F.count("*")).alias("diversity")))


@query(f"""
WITH r AS (SELECT DISTINCT doc_id, unnest({TERMS}) AS item FROM documents), c AS (SELECT item, count(*) AS c FROM r GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), k(cut) AS (VALUES (0.05::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)),
d AS (SELECT doc_id, min(c) AS lo, max(c) AS hi FROM r JOIN c USING (item) GROUP BY 1)
SELECT cut, (SELECT count(*) FROM c WHERE c::DOUBLE / n > cut) AS items, round((SELECT count(*) FILTER (WHERE c::DOUBLE / n > cut)::DOUBLE / count(*) FROM c), 6) AS item_share, round((SELECT coalesce(sum(c) FILTER (WHERE c::DOUBLE / n > cut), 0)::DOUBLE / sum(c) FROM c), 6) AS mention_share,
  round((SELECT count(*) FROM d WHERE hi::DOUBLE / n > cut)::DOUBLE / n, 6) AS hit, round((SELECT count(*) FROM d WHERE lo::DOUBLE / n > cut)::DOUBLE / n, 6) AS emptied FROM k, n""")
def t13_df_distribution(spark, d):
    return rounded(M.df_distribution(t(spark, d, "documents"), "doc_id", terms(), [0.05, 0.2, 0.5]))


@query("""
WITH v AS (SELECT label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), p AS (SELECT label, unnest(range(1, 65)) AS i, e, l FROM v),
m AS (SELECT label, i, avg(e[i] / l) AS m, count(*) AS n FROM p GROUP BY 1, 2) SELECT label::BIGINT AS label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS coherence FROM m GROUP BY 1""")
def t9_coherence(spark, d):
    return rounded(M.coherence(t(spark, d, "embeddings"), "label", "embedding"))


@query("""
WITH p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, r.label, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM p), v AS (SELECT query, label, count(*) AS n FROM k WHERE rank <= 10 GROUP BY 1, 2),
w AS (SELECT query, label, n, sum(n) OVER (PARTITION BY query) AS a, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS r FROM v)
SELECT query, CASE WHEN n::DOUBLE / a >= 0.5 THEN label::BIGINT END AS label, round(n::DOUBLE / a, 6) AS agreement FROM w WHERE r = 1""")
def t20_knn_vote(spark, d):
    rows = t(spark, d, "embeddings")
    return rounded(M.knn_vote(V.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10), rows, "vec_id", "label", 0.5))


def order_profiles(spark, d):
    """Orders as profiles: the brands of an order are its skills, its priority is the sector and its status the degree."""
    parts = t(spark, d, "part").select("p_partkey", "p_brand")
    skills = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_brand")).alias("skills"))
    return t(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority").alias("sectors"), F.col("o_orderstatus").alias("degree")).join(skills, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "sectors", "degree", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


@query("""
WITH b AS (SELECT DISTINCT o_orderkey, o_orderpriority AS s, o_orderstatus AS g, p_brand AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
z AS (SELECT s, g, count(DISTINCT o_orderkey) AS n FROM b GROUP BY 1, 2), y AS (SELECT s, count(DISTINCT o_orderkey) AS n FROM b GROUP BY 1),
u AS (SELECT o_orderkey, o_orderpriority AS s, CASE WHEN z.n >= 20 THEN o_orderstatus END AS g, CASE WHEN z.n >= 20 THEN z.n ELSE y.n END AS bucket_size FROM orders JOIN y ON y.s = o_orderpriority AND y.n >= 20 LEFT JOIN z ON z.s = o_orderpriority AND z.g = o_orderstatus),
c AS (SELECT s, g, k, count(*) AS n FROM b GROUP BY 1, 2, 3 UNION ALL SELECT s, NULL, k, count(*) FROM b GROUP BY 1, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY n DESC, k) AS rn FROM c), l AS (SELECT s, g, string_agg(k, ',' ORDER BY rn) AS skills FROM r WHERE rn <= 10 GROUP BY 1, 2)
SELECT o_orderkey, skills, CASE WHEN u.g IS NULL THEN 'sector_only' ELSE 'sector_degree' END AS bucket_type, bucket_size FROM u JOIN l ON l.s = u.s AND l.g IS NOT DISTINCT FROM u.g""")
def p2_sector_degree_prior(spark, d):
    profiles = order_profiles(spark, d)
    out = P.default_skills(profiles, P.prior_buckets(profiles), "o_orderkey")
    return out.select("o_orderkey", F.array_join("default_skills", ",").alias("skills"), "bucket_type", "bucket_size")


@query("""
WITH l AS (SELECT lower(trim(n_name)) AS label, min(n_nationkey) AS code FROM nation GROUP BY 1), x AS (SELECT DISTINCT p_type, lower(trim(p_type)) AS q FROM part),
m AS (SELECT p_type, label, code, row_number() OVER (PARTITION BY p_type ORDER BY q = label DESC, length(label) DESC, label) AS rn FROM x JOIN l ON contains(q, label) OR contains(label, q))
SELECT x.p_type, m.label AS n_name, m.code::BIGINT AS n_nationkey FROM x LEFT JOIN m ON m.p_type = x.p_type AND rn = 1""")
def j7_match_labels(spark, d):
    return rounded(P.match_labels(t(spark, d, "part").select("p_type").distinct(), "p_type", t(spark, d, "nation"), "n_name", "n_nationkey"))


@query("""
WITH r AS (SELECT l_suppkey AS occupation, l_partkey AS skill, l_returnflag = 'R' AS o, l_orderkey * 10 + l_linenumber AS p FROM lineitem),
f AS (SELECT occupation, skill, min({'o': o, 'p': p}) AS spot FROM r GROUP BY 1, 2) SELECT occupation, string_agg(CAST(skill AS VARCHAR), ',' ORDER BY spot, skill) AS skills FROM f GROUP BY 1""")
def j6_occupation_skills(spark, d):
    rel = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("occupation"), F.col("l_partkey").alias("skill"), F.when(F.col("l_returnflag") == "R", "optional").otherwise("essential").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return P.occupation_skills(rel).select("occupation", F.array_join(F.transform("skills", lambda x: x.cast("string")), ",").alias("skills"))


@query(rf"""WITH a AS (SELECT *, {NORM} AS n FROM documents), k AS (SELECT doc_id, source, md5(text) AS x, CASE WHEN length(n) >= 80 THEN md5(substr(n, 1, 300)) END AS y FROM a)
SELECT doc_id, CASE WHEN source = 'src3' THEN 'src1' ELSE source END AS source FROM k d WHERE d.source IS DISTINCT FROM 'src3' OR NOT EXISTS (SELECT 1 FROM k c WHERE c.source = 'src1' AND (c.x = d.x OR c.y = d.y))""")
def j13_merge_alias(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    keys = C.posting_keys(F.lit(""), F.col("doc_id"), F.lit(None), F.col("source"), F.lit(""), F.lit(""), F.col("text"))
    return P.merge_alias(docs, "source", "src3", "src1", [F.md5("text"), keys["text"]]).select("doc_id", "source")
