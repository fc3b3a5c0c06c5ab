"""Queries of candidate terms, vectors, coherence, occupation overlap, seeded clusters, draws and audits, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.functions import text as X
from corpusstat.operators import audit as A
from corpusstat.operators import mining as M
from corpusstat.operators import relate as R
from corpusstat.operators import sampling as D
from corpusstat.operators import similar as S
from corpusstat.operators import vectors as V
from corpusstat.plans.queries import TERMS, query, rounded, terms
from corpusstat.plans.series import POSTINGS, postings
from corpusstat.sources.readers import table as t

COS = "round(list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[]), 6)"


@query(f"""WITH g AS (SELECT doc_id, lang, source, {TERMS} AS w FROM documents), n AS (SELECT count(*) FILTER (WHERE lang = 'en') AS na, count(*) FILTER (WHERE lang <> 'en') AS nb FROM documents),
u AS (SELECT DISTINCT doc_id, lang, source, array_to_string(w[i:i + k - 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM g, (VALUES (1), (2)) v(k) WHERE len(w) >= k)),
c AS (SELECT term, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang <> 'en') AS b, count(DISTINCT source) FILTER (WHERE lang = 'en') AS titles FROM u GROUP BY 1),
z AS (SELECT term, a, titles, round((ln((a + 0.5::DOUBLE) / (na - a + 0.5::DOUBLE)) - ln((b + 0.5::DOUBLE) / (nb - b + 0.5::DOUBLE))) / sqrt(1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE)), 6) AS z FROM c, n),
k AS (SELECT * FROM z WHERE z > 0 AND titles >= 2 AND split_part(term, ' ', 1) <> 'the' AND split_part(term, ' ', -1) <> 'the'), two AS (SELECT unnest(string_split(term, ' ')) AS term, a FROM k WHERE contains(term, ' ')), m AS (SELECT term, max(a) AS a2 FROM two GROUP BY 1)
SELECT term, a, z, titles FROM k LEFT JOIN m USING (term) WHERE contains(term, ' ') OR a2 IS NULL OR a2 < 0.8 * a ORDER BY z DESC, term LIMIT 100""")
def t2b_candidate_sheet(spark, d):
    df = t(spark, d, "documents")
    grams = F.concat(M.ngrams(F.array(terms()), 1), M.ngrams(F.array(terms()), 2))
    scored = rounded(M.log_odds(df, "doc_id", grams, F.col("lang") == "en")).drop("b")
    found = df.where("lang = 'en'").select(F.explode(grams).alias("term"), F.col("source").alias("title"))
    return rounded(S.candidate_sheet(scored, found, R.overlaps_seed(F.col("term"), ["the"]), 2, 0.8, 100))


@query(f"""WITH p AS (SELECT q.vec_id AS query, q.label, r.vec_id AS neighbour, {COS.format("q.embedding", "r.embedding")} AS cosine FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM p) WHERE rank <= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY neighbour ORDER BY cosine DESC, query) AS r, (SELECT count(DISTINCT x.query // 200) FROM k x WHERE x.neighbour = k.neighbour) AS n_seeds FROM k)
SELECT neighbour, cosine AS sim, 'term' || query // 200 AS nearest_seed, 'c' || label AS channel, n_seeds FROM b WHERE r = 1 ORDER BY sim DESC, neighbour LIMIT 50""")
def t4_expansion(spark, d):
    rows = t(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    seeds = asked.select(F.col("vec_id").alias("query"), F.concat(F.lit("term"), F.floor(F.col("vec_id") / 200)).alias("term"), F.concat(F.lit("c"), "label").alias("channel"))
    return rounded(S.expansion(V.nearest(asked, rows, "vec_id", "embedding", 20), seeds, 50))


@query(f"""WITH p AS (SELECT s.vec_id % 40 AS unit, k.vec_id AS skill, {COS.format("s.embedding", "k.embedding")} AS sim FROM embeddings s, embeddings k WHERE k.vec_id % 100 = 0)
SELECT unit, skill, max(sim) AS sim, count(*) AS sentences, round(floor(max(sim) * 20) / 20, 6) AS band FROM p WHERE sim >= 0.2 GROUP BY 1, 2""")
def t6_sentence_matches(spark, d):
    rows = t(spark, d, "embeddings")
    sentences = rows.select((F.col("vec_id") % 40).alias("unit"), "embedding")
    return rounded(S.sentence_matches(sentences, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("skill"), "embedding"), "unit", "embedding", "skill", 0.2))


@query()
def t9_coherence_lift(spark, d):
    """With T17; held against brute force on a small fixture."""
    items = F.array(F.concat(F.lit("l"), "label"), F.concat(F.lit("m"), F.col("vec_id") % 7))
    return rounded(S.coherence_lift(t(spark, d, "embeddings"), "vec_id", "embedding", items, 5))


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey % 8 END AS cluster FROM orders), i AS (SELECT DISTINCT l_orderkey AS id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), h AS (SELECT * FROM m JOIN i USING (id)),
f AS (SELECT item, ln((SELECT count(DISTINCT id) FROM h)::DOUBLE / count(*)) AS idf FROM h GROUP BY 1), w AS (SELECT cluster, count(DISTINCT id) AS with_items FROM h WHERE cluster >= 0 GROUP BY 1 HAVING count(DISTINCT id) >= 5),
p AS (SELECT cluster, item, with_items, count(*)::DOUBLE / with_items * idf AS x FROM h JOIN w USING (cluster) JOIN f USING (item) GROUP BY cluster, item, with_items, idf), rel AS (SELECT p_size AS occupation, p_brand AS item, bool_or(p_partkey % 2 = 0) AS essential FROM part GROUP BY 1, 2),
o AS (SELECT occupation, item, CASE WHEN essential THEN 1.0::DOUBLE ELSE 0.5 END * idf AS y FROM rel JOIN f USING (item)), d AS (SELECT cluster, with_items, occupation, sum(x * y) AS dot FROM p JOIN o USING (item) GROUP BY 1, 2, 3),
s AS (SELECT cluster, with_items, occupation, round(dot / (nx * ny), 6) AS score FROM d JOIN (SELECT cluster, sqrt(sum(x * x)) AS nx FROM p GROUP BY 1) USING (cluster) JOIN (SELECT occupation, sqrt(sum(y * y)) AS ny FROM o GROUP BY 1) USING (occupation) WHERE nx > 0 AND ny > 0)
SELECT * FROM (SELECT cluster, with_items, occupation::BIGINT AS occupation, score, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, occupation) AS rank FROM s) WHERE rank <= 3""")
def t18_occupation_overlap(spark, d):
    part = t(spark, d, "part")
    members = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 9 == 0, -1).otherwise(F.col("o_custkey") % 8).alias("cluster"))
    items = t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("item")).distinct()
    relations = part.groupBy(F.col("p_size").alias("occupation"), F.col("p_brand").alias("item")).agg(F.bool_or(F.col("p_partkey") % 2 == 0).alias("essential"))
    return rounded(S.occupation_overlap(members, items, relations, "id", "cluster", 5, 3))


@query()
def t19_seeded_clusters(spark, d):
    rows = t(spark, d, "embeddings").withColumn("seed", F.when((F.col("vec_id") % 25 == 0) & (F.col("label") < 5), F.concat(F.lit("s"), "label")))
    return S.seeded_clusters(rows, "vec_id", "embedding", "seed")[0]


# Draws

U = "(CAST('0x' || substr(md5('1|' || {}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH dd AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total FROM orders GROUP BY 1), p AS (SELECT day, CAST(ceil(total / 2) AS BIGINT) AS pages, (k + {U.format("day")}) / 3 AS u FROM dd, range(3) AS r(k))
SELECT DISTINCT day, pages, CAST(least(pages, floor(u * pages) + 1) AS BIGINT) AS page FROM p""")
def s3_page_draw(spark, d):
    days = t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("total"))
    return D.page_draw(days, "day", "total", 2, 3)


@query(f"SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {U.format('o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 20")
def s8_per_group(spark, d):
    """With S7 and S11."""
    return D.per_group(t(spark, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 20)


@query(f"""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_discount >= 0.08 THEN 2 WHEN l_discount >= 0.05 THEN 1 WHEN l_discount >= 0.02 THEN 0 END AS band, l_partkey AS text FROM lineitem), f AS (SELECT band, min(id) AS id FROM b WHERE band IS NOT NULL GROUP BY band, text)
SELECT band::BIGINT AS band, id FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {U.format('id')}, id) AS r FROM f) WHERE r <= 15""")
def s9_from_bands(spark, d):
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount", F.col("l_partkey").alias("text"))
    return rounded(D.from_bands(rows, "l_discount", [0.02, 0.05, 0.08], "id", "text", 15).select("band", "id"))


@query("""WITH n AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), l AS (SELECT max(l) AS l FROM range(0, 101) AS r(l) WHERE (SELECT sum(least(n, l)) FROM n) <= 100),
a AS (SELECT p_size, least(n, l) AS g, n > l AS room FROM n, l), b AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY p_size) AS k FROM a)
SELECT p_size::BIGINT AS p_size, CAST(g + CASE WHEN room AND k <= 100 - (SELECT sum(g) FROM a) THEN 1 ELSE 0 END AS BIGINT) AS n FROM b WHERE g + CASE WHEN room AND k <= 100 - (SELECT sum(g) FROM a) THEN 1 ELSE 0 END > 0""")
def s5_allocated(spark, d):
    rows = D.allocated(t(spark, d, "part").select("p_size", "p_partkey"), "p_size", "p_partkey", 100)
    return rounded(rows.groupBy("p_size").agg(F.count("*").alias("n")))


@query()
def p17_board_comparison(spark, d):
    """Boards are languages, labels the words of two letters."""
    df = t(spark, d, "documents").where("lang is not null").select("doc_id", "lang", (1 + F.col("doc_id") % 3).alias("w"), F.filter(terms(), lambda x: F.length(x) == 2).alias("labels"))
    return rounded(D.board_comparison(df, "lang", "doc_id", "w", F.col("labels"), 50))


# Audits and counts

@query("""SELECT k AS field, count(*) AS rows, count(*) FILTER (WHERE props IS NOT NULL AND json_exists(props, '$.' || k)) AS present, count(*) FILTER (WHERE coalesce(trim(json_extract_string(props, '$.' || k)), '') <> '') AS filled FROM events, (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events) GROUP BY 1""")
def pb5_key_inventory(spark, d):
    """With P10's fields."""
    return A.key_inventory(t(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("m")), "m")


@query("""WITH a AS (SELECT c_mktsegment AS sector, c_nationkey % 4 AS degree, count(*) AS n FROM customer GROUP BY 1, 2) SELECT 'sector' AS bucket, count(*) AS buckets, count(*) FILTER (WHERE n >= 290) AS large, max(n)::BIGINT AS largest, min(n)::BIGINT AS smallest FROM (SELECT sector, sum(n) AS n FROM a GROUP BY 1)
UNION ALL SELECT 'sector and degree', count(*), count(*) FILTER (WHERE n >= 290), max(n)::BIGINT, min(n)::BIGINT FROM a""")
def pb6_bucket_sparsity(spark, d):
    return A.bucket_sparsity(t(spark, d, "customer").withColumn("degree", F.col("c_nationkey") % 4), "c_mktsegment", "degree", 290)


@query("""WITH a AS (SELECT c_nationkey % 3 AS source, c_mktsegment AS sector, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, sector) AS rank, sum(n) OVER (PARTITION BY source) AS total, max(n) OVER (PARTITION BY source) AS most FROM a)
SELECT source::BIGINT AS source, sector, n, rank, CAST(ceil(total * 20 / most) AS BIGINT) AS projected FROM r WHERE rank <= 3""")
def pb7_sectors_by_source(spark, d):
    df = t(spark, d, "customer").withColumn("source", (F.col("c_nationkey") % 3).cast("long"))
    return rounded(A.top_by_source(df, "source", F.array("c_mktsegment"), 3, 20).withColumnRenamed("label", "sector"))


@query("""WITH a AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS source, o_orderkey % 3 = 0 AS tagged FROM orders) SELECT month, source, count(*) AS n, round(100.0 * count(*) FILTER (WHERE tagged) / count(*), 6) AS percent FROM a GROUP BY 1, 2""")
def pb16_fill_by_month(spark, d):
    df = t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, "x").alias("tag"))
    return rounded(A.fill_by(df, ["month", "source"], F.col("tag").isNotNull()))


@query(f"""WITH {POSTINGS}, w AS (SELECT * FROM posting WHERE day BETWEEN DATE '1996-03-04' AND DATE '1996-06-10'), t AS (SELECT template, count(*) AS n FROM w GROUP BY 1), b AS (SELECT template FROM t ORDER BY n DESC, template LIMIT 3)
SELECT template, count(*) AS n, round(count(*) / (SELECT count(*) FROM w)::DOUBLE, 6) AS share, round(avg(CASE WHEN channel IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS flagged, count(DISTINCT channel) AS channels FROM w WHERE template IN (FROM b) GROUP BY 1""")
def pb18_week_inspection(spark, d):
    df = R.between(postings(spark, d), "day", "1996-03-04", "1996-06-10")
    return rounded(A.template_report(df, F.col("template"), "channel", 3))


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY similarity, id LIMIT 20")
def pb20_least_similar(spark, d):
    return rounded(A.least_similar(t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get("embedding", 0).cast("double").alias("similarity")), "label", 3, "similarity", "id", 20))


@query("SELECT c_nationkey::BIGINT AS code, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM customer GROUP BY 1")
def a32_location_codes(spark, d):
    return rounded(A.value_counts(t(spark, d, "customer"), "c_nationkey").withColumnRenamed("c_nationkey", "code"))


@query(f"""WITH {POSTINGS} SELECT year(day) || '-Q' || quarter(day) AS period, count(*) AS n, round(sum(CASE WHEN regexp_matches(lower(title), '(high|urgent)') THEN w ELSE 0 END) / sum(w), 6) AS share FROM posting GROUP BY 1""")
def a37_place_titles(spark, d):
    df = postings(spark, d).withColumn("period", X.quarter(F.col("day")))
    return rounded(A.pattern_share(df, ["period"], F.col("title"), ["high", "urgent"], "w"))


@query(f"""WITH {POSTINGS} SELECT region AS firm, count(*) FILTER (WHERE channel = 'BUILDING') AS "BUILDING", count(*) FILTER (WHERE channel = 'MACHINERY') AS "MACHINERY", count(*) FILTER (WHERE channel IS NULL) AS none, count(*) AS total FROM posting WHERE region IS NOT NULL GROUP BY 1""")
def a40_firm_by_channel(spark, d):
    return A.cross_tab(postings(spark, d).where("region is not null"), "region", F.coalesce("channel", F.lit("none")), ["BUILDING", "MACHINERY", "none"]).withColumnRenamed("region", "firm")
