"""Queries of field audits, answers of unknown shape, counts with unknown cells, and wildcards."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import fields as N
from corpusstat.operators import wildcards as K
from corpusstat.plans.queries import query, rounded
from corpusstat.sources.readers import table as t

#: An event as a record with a nested object, a list of objects, and fields that may be empty. The same text in Spark and DuckDB.
RECORD = """concat('{"id":', event_id, ',"upload_date":', CASE WHEN user_id % 3 > 0 THEN concat('"', CAST(CAST(ts AS DATE) AS STRING), '"') ELSE 'null' END, ',"props":', props,
 ',"tags":[{"uri":"', event_type, '","created_at":', CASE WHEN user_id % 5 = 0 THEN '""' ELSE concat('"', user_id, '"') END, '}],"note":', CASE WHEN event_id % 2 = 0 THEN '""' ELSE '{"text":"x","end":[]}' END, ',"gone":[]}')"""


@query(f"""
WITH r AS (SELECT user_id % 3 > 0 AS dated, json({RECORD}) AS v FROM events), k AS (SELECT dated, key AS path, key AS name, 0 AS level, value AS item FROM r, json_each(r.v)),
o AS (SELECT dated, path, CASE WHEN json_type(item) = 'ARRAY' THEN item -> 0 ELSE item END AS item FROM k), b AS (SELECT x.dated, x.path || '.' || j.key, j.key, 1, j.value FROM (SELECT * FROM o WHERE json_type(item) = 'OBJECT') x, json_each(x.item) j),
f AS (SELECT *, CAST(item AS VARCHAR) NOT IN ('null', '""', '[]', '{{}}') AS full_ FROM (FROM k UNION ALL FROM b)), n AS (SELECT count(*) FILTER (WHERE dated) AS a, count(*) FILTER (WHERE NOT dated) AS u FROM r)
SELECT path, level::BIGINT AS level, count(*) FILTER (WHERE dated AND full_) AS dated, count(*) FILTER (WHERE NOT dated AND full_) AS undated, round(count(*) FILTER (WHERE dated AND full_) / any_value(a), 6) AS dated_share,
 round(count(*) FILTER (WHERE NOT dated AND full_) / any_value(u), 6) AS undated_share, array_to_string(list_sort(list(DISTINCT item ->> '$') FILTER (WHERE full_ AND regexp_matches(name, '(?i){N.DATE_LIKE}')))[1:3], ' | ') AS examples FROM f, n GROUP BY path, level""")
def p10_field_audit(spark, d):
    rows = t(spark, d, "events").select("user_id", F.expr(RECORD).alias("record"))
    out = N.field_audit(rows, "record", F.col("user_id") % 3 > 0)
    return rounded(out.withColumn("examples", F.array_join("examples", " | ")))


#: A user's events as an answer: a list, for some users one in an object, and for some nothing that is JSON.
ROW = """concat('{"location":"', event_type, '","n":', CASE WHEN event_id % 9 = 0 THEN 'null' ELSE CAST(user_id * 100 - event_id AS STRING) END, ',"on":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"value":', CAST(CAST(floor(value) AS INT) AS STRING), '}')"""


@query(f"""
WITH e AS (SELECT user_id, '[' || string_agg({ROW}, ',' ORDER BY event_id) || ']' AS rows FROM events GROUP BY 1),
a AS (SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'oops' WHEN user_id % 7 = 0 THEN '{{"items":' || rows || '}}' ELSE rows END AS answer FROM e), v AS (SELECT user_id, CASE WHEN json_valid(answer) THEN json(answer) END AS v FROM a),
r AS (SELECT user_id, unnest(CAST(v AS JSON[])) AS item, generate_subscripts(CAST(v AS JSON[]), 1) - 1 AS place FROM v WHERE json_type(v) = 'ARRAY'),
c AS (SELECT user_id, place, item ->> 'location' AS location, CASE WHEN json_type(item -> 'n') <> 'NULL' THEN CAST(item ->> 'n' AS DOUBLE) END AS n, CAST(item ->> 'value' AS DOUBLE) AS value FROM r),
x AS (SELECT *, first(n ORDER BY place) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) IS NOT NULL AS has FROM c),
w AS (SELECT user_id, place, location, CASE WHEN has THEN n ELSE value END AS n, has FROM x), l AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY place) AS before FROM w WHERE n IS NOT NULL),
s AS (SELECT user_id, bool_and(coalesce(before >= n, true)) AS descends, arg_min(n, place) AS "first", arg_max(n, place) AS "last", sum(n) AS "sum", bool_or(has) AS has FROM l GROUP BY 1), y AS (SELECT user_id, count(*) AS rows, count(DISTINCT location) AS code_values FROM c GROUP BY 1)
SELECT v.user_id, lower(json_type(v)) AS kind, coalesce(rows, 0) AS rows, CASE WHEN rows > 0 THEN 'location,n,on,value' END AS fields, CASE WHEN has THEN 'n,value' WHEN rows > 0 THEN 'value' END AS numeric_fields, descends, "first", "last", "sum", CASE WHEN rows > 0 THEN 'location' END AS code, code_values
FROM v LEFT JOIN y USING (user_id) LEFT JOIN s USING (user_id)""")
def pb15_describe(spark, d):
    lists = t(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.expr(ROW).alias("row")))), lambda r: r["row"]), ","), F.lit("]")).alias("rows"))
    answer = F.when(F.col("user_id") % 11 == 0, "oops").when(F.col("user_id") % 7 == 0, F.concat(F.lit('{"items":'), "rows", F.lit("}"))).otherwise(F.col("rows"))
    out = N.describe(lists.select("user_id", answer.alias("answer")), "user_id", "answer")
    return rounded(out.withColumns({c: F.array_join(c, ",") for c in ("fields", "numeric_fields")}))


CODES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS "window", o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT "window", sum(n)::BIGINT AS total FROM c GROUP BY 1),
a AS (SELECT "window", code, CASE WHEN "window" LIKE '%-02' AND code = '2-HIGH' THEN NULL WHEN "window" LIKE '%-06' AND code = '1-URGENT' THEN total ELSE n END AS n FROM c JOIN s USING ("window") WHERE NOT ("window" LIKE '%-04' AND code = '3-MEDIUM')),
b AS (SELECT "window", count(n) FILTER (WHERE code IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS k, sum(n) FILTER (WHERE code IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))::BIGINT AS x, list(n) FILTER (WHERE code IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS l FROM a GROUP BY 1)
SELECT "window", t AS total, CASE WHEN k = 3 THEN x END AS listed, CASE WHEN k = 3 THEN t - x END AS other, coalesce(t > 0 AND list_contains(l, t), false) AS ignored FROM (SELECT *, CASE WHEN "window" NOT LIKE '%-08' THEN total END AS t FROM b JOIN s USING ("window"))""")
def pb10_other_counts(spark, d):
    """Months in which a cell is unknown, missing, or equal to the total, and in which the total is unknown."""
    counts = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("window"), F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("window").agg(F.sum("n").alias("total"))
    month = lambda m: F.col("window").endswith(m)
    cells = counts.join(totals, "window").where(~(month("-04") & (F.col("code") == "3-MEDIUM")))
    cells = cells.select("window", "code", F.when(month("-02") & (F.col("code") == "2-HIGH"), None).when(month("-06") & (F.col("code") == "1-URGENT"), F.col("total")).otherwise(F.col("n")).alias("n"))
    return N.other_counts(cells.union(totals.select("window", F.lit("TOTAL"), F.when(~month("-08"), F.col("total")))), "window", "code", "n", CODES)


CASES = [("en", "that"), ("en", "tion"), ("en", "Re"), ("fr", "reaux"), ("de", "schen"), ("es", "cion"), ("xx", "none")]


@query(rf"""
WITH c(lang, word) AS (VALUES {', '.join(f"('{a}', '{b.lower()}')" for a, b in CASES)}),
p AS (SELECT DISTINCT lang, word, unnest([word, word || '*', substr(word, 1, length(word) - 1) || '*', substr(word, 1, length(word) - 2) || '*', substr(word, 1, greatest(3, length(word) // 2)) || '*', word || 's', word || 's*', '*' || substr(word, 2)]) AS pattern FROM c),
q AS (SELECT *, replace(pattern, '*', '') AS stem FROM p WHERE replace(pattern, '*', '') <> ''), w AS (SELECT lang, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+'))) AS form FROM documents WHERE text IS NOT NULL),
m AS (SELECT q.lang, word, pattern, doc_id, form FROM q JOIN w ON q.lang = w.lang AND CASE WHEN starts_with(pattern, '*') THEN ends_with(form, stem) WHEN contains(pattern, '*') THEN starts_with(form, stem) ELSE form = pattern END),
n AS (SELECT lang, word, pattern, count(DISTINCT doc_id) AS texts FROM m GROUP BY 1, 2, 3), f AS (SELECT lang, word, pattern, form, count(*) AS n FROM m GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY lang, word, pattern ORDER BY n DESC, form) AS rn FROM f),
b AS (SELECT lang, word, pattern, string_agg(form || ' ' || n, ', ' ORDER BY rn) AS forms FROM k WHERE rn <= 6 GROUP BY 1, 2, 3)
SELECT lang, word, pattern, coalesce(texts, 0) AS texts, coalesce(forms, '') AS forms FROM (SELECT DISTINCT lang, word, pattern FROM q) LEFT JOIN n USING (lang, word, pattern) LEFT JOIN b USING (lang, word, pattern)""")
def pb12_keyword_forms(spark, d):
    cases = spark.createDataFrame(CASES, "lang string, word string")
    return K.keyword_forms(t(spark, d, "documents"), "doc_id", ["lang"], F.col("text"), cases, "word")


@query(r"""
WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}]+'))) AS form FROM documents WHERE lang = 'en'), s AS (SELECT form, count(*) AS n FROM w GROUP BY 1),
f AS (SELECT regexp_replace(form, '(ing|ed|er|es|s)$', '') AS word, form, n FROM s), g AS (SELECT word, form, n FROM f WHERE length(word) >= 3 AND word IN (SELECT word FROM f GROUP BY 1 HAVING count(*) >= 3)),
e AS (SELECT word, min(form) AS a, max(form) AS b, sum(n) AS own, count(*) AS own_words FROM g GROUP BY 1), l AS (SELECT *, unnest(range(3, least(length(a), length(b)) + 1)) AS k FROM e), p AS (SELECT word, k, own, own_words, a[1:k] AS prefix FROM l WHERE a[1:k] = b[1:k]),
x AS (SELECT form, n, unnest(list_transform(range(3, length(form) + 1), lambda k: form[1:k])) AS prefix FROM s WHERE length(form) >= 3), u AS (SELECT prefix, sum(n) AS mentions, count(*) AS words FROM x GROUP BY 1),
h AS (SELECT *, mentions - own AS others FROM p JOIN u USING (prefix)), c AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY others / mentions <= 0.05 DESC, CASE WHEN others / mentions <= 0.05 THEN k ELSE -k END) AS rn FROM h),
b AS (SELECT * FROM c WHERE rn = 1), o AS (SELECT b.word, x.form, x.n, row_number() OVER (PARTITION BY b.word ORDER BY x.n DESC, x.form) AS rn FROM b JOIN x USING (prefix) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.word = b.word AND g.form = x.form)),
t AS (SELECT word, string_agg(form || ' ' || n, ', ' ORDER BY rn) AS other_forms FROM o WHERE rn <= 6 GROUP BY 1)
SELECT word, prefix || '*' AS wildcard, own::BIGINT AS own_mentions, others::BIGINT AS others, words - own_words AS other_words, coalesce(other_forms, '') AS other_forms FROM b LEFT JOIN t USING (word)""")
def pb12_shortest_wildcards(spark, d):
    """Families of English words by their endings, and the wildcards of which at most 5 % of the mentions are others'."""
    words = t(spark, d, "documents").where("lang = 'en'").select(F.explode(K.words_of(F.col("text"))).alias("form"))
    seen = words.groupBy("form").agg(F.count("*").alias("n"))
    stems = seen.select(F.regexp_replace("form", "(ing|ed|er|es|s)$", "").alias("word"), "form")
    large = stems.where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("k")).where("k >= 3").select("word")
    return K.shortest_wildcards(seen, stems.join(large, "word"), 3, 0.05)
