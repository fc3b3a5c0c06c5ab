"""Queries of rules, labels, lexicons, scores and reference levels, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import rules as R
from corpusstat.operators import scores as S
from corpusstat.plans.queries import query, rounded
from corpusstat.plans.series import TAGS, postings, POSTINGS, tags
from corpusstat.sources.readers import table as t

TERMED = TAGS + """, termed AS (SELECT *, CASE id % 6 WHEN 0 THEN ['lithium', 'x'] WHEN 1 THEN ['copper'] WHEN 2 THEN [] ELSE ['x'] END AS terms FROM tag)"""


def termed(spark, d):
    key = F.col("id") % 6
    made = F.when(key == 0, F.array(F.lit("lithium"), F.lit("x"))).when(key == 1, F.array(F.lit("copper"))).when(key == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return tags(spark, d).withColumn("terms", made)


@query(f"""WITH {TERMED}, r AS (SELECT *, ok AND channel = 'critical materials' AND NOT list_contains(terms, 'lithium') AS hit FROM termed)
SELECT id, CASE WHEN hit THEN 'none' ELSE channel END AS channel, CASE WHEN hit THEN 'none' ELSE intensity END AS intensity, CASE WHEN hit THEN channel END AS channel_model, CASE WHEN hit THEN intensity END AS intensity_model, CASE WHEN hit THEN 'no anchored term' END AS post_rule FROM r""")
def p4_anchored(spark, d):
    return R.anchored(termed(spark, d)).select("id", "channel", "intensity", "channel_model", "intensity_model", "post_rule")


@query(f"""WITH {TERMED}, r AS (SELECT *, CASE WHEN NOT ok AND id % 2 = 0 THEN 'retry' WHEN channel = 'other' THEN 'other' WHEN channel = 'other' OR list_contains(terms, 'copper') THEN 'metal' END AS rule FROM termed)
SELECT id, CASE rule WHEN 'retry' THEN 'defense' WHEN 'other' THEN 'none' WHEN 'metal' THEN 'critical materials' ELSE channel END AS channel, CASE rule WHEN 'other' THEN 'none' ELSE intensity END AS intensity,
CASE WHEN rule IS NOT NULL THEN channel END AS channel_model, CASE WHEN rule IS NOT NULL THEN intensity END AS intensity_model, rule AS post_rule FROM r""")
def p3_first_rule(spark, d):
    """The rules' engine: the first that holds wins and is logged; the reference's four are tested on made-up tags."""
    rules = [("retry", ~F.col("ok") & (F.col("id") % 2 == 0), {"channel": F.lit("defense")}), ("other", F.col("channel") == "other", {"channel": F.lit("none"), "intensity": F.lit("none")}),
             ("metal", (F.col("channel") == "other") | F.array_contains("terms", "copper"), {"channel": F.lit("critical materials")})]
    return R.ruled(termed(spark, d), rules).select("id", "channel", "intensity", "channel_model", "intensity_model", "post_rule")


LABELLED = "lab AS (SELECT o_orderkey AS id, [' Defense ', 'none', '', 'diversification', 'cooking'][1 + o_orderkey % 5] AS channel, ['HIGH', '', 'low', 'medium'][1 + o_orderkey % 4] AS intensity FROM orders WHERE o_orderkey % 7 = 0)"


def manual(spark, d):
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n).cast("int"))
    rows = t(spark, d, "orders").where("o_orderkey % 7 = 0")
    return rows.select(F.col("o_orderkey").alias("id"), at([" Defense ", "none", "", "diversification", "cooking"], 5).alias("channel"), at(["HIGH", "", "low", "medium"], 4).alias("intensity"))


@query(f"""WITH {LABELLED}, a AS (SELECT id, lower(trim(channel)) AS c, lower(trim(intensity)) AS i FROM lab) SELECT * FROM (SELECT id, CASE WHEN c = 'cooking' THEN 'unknown channel or intensity' WHEN c <> 'none' AND i IN ('', 'none') THEN 'intensity missing' END AS problem FROM a WHERE c <> '') WHERE problem IS NOT NULL""")
def p5_label_problems(spark, d):
    return R.label_problems(manual(spark, d), "id")


@query(f"""WITH {TAGS}, {LABELLED}, m AS (SELECT id, lower(trim(channel)) AS c, lower(trim(intensity)) AS i FROM lab WHERE trim(channel) <> ''), x AS (SELECT tag.*, 'sub' AS subtype, CASE WHEN id % 2 = 0 THEN 'earlier' END AS rule FROM tag)
SELECT x.id, x.ok, coalesce(c, channel) AS channel, CASE WHEN c = 'none' THEN 'none' WHEN c IS NOT NULL THEN i ELSE intensity END AS intensity, CASE WHEN c <> 'diversification' THEN '' ELSE subtype END AS subtype,
CASE WHEN c IS NOT NULL THEN concat_ws('; ', rule, 'manual_review') ELSE rule END AS rule, CASE WHEN c IS NOT NULL THEN channel END AS channel_before, CASE WHEN c IS NOT NULL THEN intensity END AS intensity_before FROM x LEFT JOIN m USING (id)""")
def p5_relabelled(spark, d):
    """With P11 and P16."""
    rows = tags(spark, d).withColumns({"subtype": F.lit("sub"), "rule": F.when(F.col("id") % 2 == 0, "earlier")})
    return R.relabelled(rows, manual(spark, d), "id")


@query(f"WITH {TAGS}, {LABELLED} SELECT id FROM lab WHERE id NOT IN (SELECT id FROM tag)")
def p5_unmatched(spark, d):
    return R.unmatched(manual(spark, d), tags(spark, d), "id")


@query(r"""WITH s AS (SELECT lower(p_brand) AS term, 'defense' AS channel FROM part WHERE p_partkey <= 5), k AS (SELECT regexp_replace(term, '[-\s]+', ' ', 'g') AS key, channel, -1 AS place, term, 'seed' AS source FROM s),
h AS (SELECT p_partkey AS place, 'sheet' AS source, p_brand AS term, CASE p_partkey % 3 WHEN 0 THEN 'defense' WHEN 1 THEN 'reshoring' ELSE 'cooking' END AS channel FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 5),
g AS (SELECT * FROM k UNION ALL SELECT regexp_replace(lower(trim(term)), '[-\s]+', ' ', 'g'), channel, place, trim(term), source FROM h WHERE channel <> 'cooking'), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, term) AS r FROM g)
SELECT term, channel, source FROM s, (VALUES ('seed')) v(source) UNION ALL SELECT term, channel, source FROM f WHERE r = 1 AND place >= 0""")
def p6_lexicon(spark, d):
    return R.lexicon(*lexicon_parts(spark, d))[0]


@query(r"""WITH s AS (SELECT lower(p_brand) AS term, 'defense' AS channel FROM part WHERE p_partkey <= 5), k AS (SELECT regexp_replace(term, '[-\s]+', ' ', 'g') AS key, channel, -1 AS place, term FROM s),
h AS (SELECT p_partkey AS place, p_brand AS term, CASE p_partkey % 3 WHEN 0 THEN 'defense' WHEN 1 THEN 'reshoring' ELSE 'cooking' END AS channel FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 5),
g AS (SELECT * FROM k UNION ALL SELECT regexp_replace(lower(trim(term)), '[-\s]+', ' ', 'g'), channel, place, trim(term) FROM h WHERE channel <> 'cooking'), f AS (SELECT *, first_value(channel) OVER (PARTITION BY key ORDER BY place, term) AS c FROM g)
SELECT term, 'unknown channel ' || channel AS problem FROM h WHERE channel = 'cooking' UNION ALL SELECT term, 'already under ' || c || ', now ' || channel FROM f WHERE channel <> c""")
def p6_lexicon_problems(spark, d):
    return R.lexicon(*lexicon_parts(spark, d))[1]


def lexicon_parts(spark, d):
    part, key = t(spark, d, "part"), F.col("p_partkey")
    seeds = part.where("p_partkey <= 5").select(F.lower("p_brand").alias("term"), F.lit("defense").alias("channel"), F.lit("").alias("variants"))
    channel = F.when(key % 3 == 0, "defense").when(key % 3 == 1, "reshoring").otherwise("cooking")
    sheets = part.where("p_partkey > 5").select(key.alias("place"), F.lit("sheet").alias("source"), F.col("p_brand").alias("term"), channel.alias("channel"), F.when(key % 2 == 0, "Yes").alias("keep"))
    return seeds, sheets


@query(r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), b AS (SELECT doc_id, len(regexp_extract_all(x, '(?i)ba')) AS n, list_sum(list_transform(regexp_extract_all(x, '(?i)bar[a-z]*'), lambda m: len(regexp_extract_all(m, '(?i)ba')))) AS inner_n, x FROM a),
c AS (SELECT doc_id, CASE WHEN n > 0 AND coalesce(inner_n, 0) >= n THEN regexp_replace(x, '(?i)ba', ' ', 'g') ELSE x END AS x FROM b)
SELECT doc_id, 'strong' AS tier FROM c WHERE regexp_matches(x, '(?i)ba') UNION ALL SELECT doc_id, 'weak' FROM c WHERE regexp_matches(x, '(?i)zo')""")
def p7_wording_tiers(spark, d):
    return R.wording_tiers(t(spark, d, "documents"), "doc_id", F.col("text"), {"strong": "ba", "weak": "zo"}, ("ba", "bar[a-z]*")).select("doc_id", "tier")


@query(f"""WITH {POSTINGS} SELECT strftime(day, '%Y-%m') AS month, round(coalesce(sum(w) FILTER (WHERE region IN ('NATION_1', 'NATION_7')), 0), 6) AS weight, round(coalesce(sum(w) FILTER (WHERE region IN ('NATION_1', 'NATION_7')), 0) / sum(w), 6) AS share,
count(DISTINCT region) FILTER (WHERE region IN ('NATION_1', 'NATION_7')) AS firms FROM posting GROUP BY 1""")
def p8_watchlist(spark, d):
    df = postings(spark, d).withColumn("month", F.date_format("day", "yyyy-MM"))
    return rounded(R.watchlist(df, "month", F.concat(F.lit("The "), "region", F.lit(", Ltd.")), ["nation_1", "nation_7"], "w"))


@query("""WITH a AS (SELECT doc_id, list_filter(['ba', 'der', 'zo'], lambda x: contains(lower(coalesce(text, '')), x)) AS there, list_filter(['ba', 'der', 'zo'], lambda x: contains(lower(coalesce(text, '')), x) AND instr(lower(text), x) + length(x) - 1 > 200) AS late FROM documents)
SELECT doc_id, late FROM a WHERE len(there) > 0 AND len(there) = len(late)""")
def p12_truncation_exposed(spark, d):
    return R.truncation_exposed(t(spark, d, "documents"), "doc_id", F.col("text"), F.array(*map(F.lit, ("ba", "der", "zo"))), 200)


@query(f"""WITH {TAGS}, old AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'none' ELSE channel END AS channel FROM tag WHERE id % 3 <> 0), x AS (SELECT id, coalesce(old.channel, 'none') AS before, coalesce(tag.channel, 'none') AS now FROM tag FULL JOIN old USING (id))
SELECT *, CASE WHEN before = 'none' THEN 'new' ELSE 'removed' END AS change FROM x WHERE (before = 'none') <> (now = 'none')""")
def p13_review_sheet(spark, d):
    now = tags(spark, d)
    old = now.where("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, "none").otherwise(F.col("channel")).alias("channel"))
    return R.review_sheet(now, old, "id")


# Scores

SCORED = """sc AS (SELECT l_orderkey % 3 <> 0 AS flagged, l_quantity AS w, ['none', 'A', 'N', 'R'][1 + (l_orderkey + l_linenumber) % 4] AS truth, CASE WHEN l_partkey % 11 = 0 THEN 'invalid' WHEN l_partkey % 3 = 0 THEN l_returnflag ELSE ['none', 'A', 'N', 'R'][1 + (l_orderkey + l_linenumber) % 4] END AS said,
 l_suppkey % 3 AS ti, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey % 3 END AS si FROM lineitem)"""


def scored(spark, d):
    key = F.col("l_partkey")
    truth = F.get(F.array(*map(F.lit, ("none", "A", "N", "R"))), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4).cast("int"))
    return t(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 3 != 0).alias("flagged"), F.col("l_quantity").alias("w"), truth.alias("truth"),
        F.when(key % 11 == 0, "invalid").when(key % 3 == 0, F.col("l_returnflag")).otherwise(truth).alias("said"),
        (F.col("l_suppkey") % 3).alias("ti"), F.when(F.col("l_suppkey") % 7 != 0, key % 3).alias("si"),
    )


@query(f"""WITH {SCORED}, f AS (SELECT * FROM sc WHERE flagged), k AS (SELECT c, (SELECT sum(w) FROM f WHERE truth = c) AS t, (SELECT coalesce(sum(w), 0) FROM f WHERE said = c) AS p, (SELECT coalesce(sum(w), 0) FROM f WHERE said = c AND truth = c) AS tp FROM (SELECT DISTINCT truth AS c FROM f WHERE truth <> 'none'))
SELECT round(avg(2 * tp / (t + p)), 6) AS macro_f1, count(*) AS classes, (SELECT round(sum(CASE WHEN truth <> 'none' THEN w ELSE 0 END) / sum(w), 6) FROM f) AS lexicon_precision, (SELECT round(sum(CASE WHEN truth <> 'none' THEN w ELSE 0 END) / sum(w), 6) FROM sc WHERE NOT flagged) AS lexicon_miss,
(SELECT round(sum(CASE WHEN ti = si THEN w ELSE 0 END) / sum(w), 6) FROM f WHERE truth = said AND truth NOT IN ('none', 'invalid') AND si IS NOT NULL) AS intensity_agreement FROM k""")
def e2_macro_scores(spark, d):
    return rounded(S.macro_scores(scored(spark, d), "truth", "said", "flagged", "w", ("ti", "si")))


@query("""WITH a AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN doc_id % 7 = 0 THEN '' WHEN toxic = 1 OR quality = 0 THEN 'bad' ELSE 'good' END AS b FROM labels), p AS (SELECT * FROM a WHERE b <> ''), c AS (SELECT a, b, count(*)::DOUBLE AS x FROM p GROUP BY 1, 2),
n AS (SELECT sum(x) AS n, sum(x) FILTER (WHERE a = b) / sum(x) AS o FROM c), e AS (SELECT sum(r * s) / any_value(n * n) AS e FROM (SELECT a, sum(x) AS r FROM c GROUP BY 1) JOIN (SELECT b AS a, sum(x) AS s FROM c GROUP BY 1) USING (a), n)
SELECT CAST(n AS BIGINT) AS n, round(o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa FROM n, e""")
def e24_two_passes(spark, d):
    rows = t(spark, d, "labels")
    first = rows.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    second = rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").when((F.col("toxic") == 1) | (F.col("quality") == 0), "bad").otherwise("good").alias("label"))
    return rounded(S.two_passes(first, second, "doc_id", "label"))


DRAWN = "(CAST('0x' || substr(md5('1|' || s || '|' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH h AS (SELECT s, event_type AS c, {DRAWN} < 0.5 AS a FROM events, range(1, 301) AS r(s)), c AS (SELECT s, c, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE NOT a) AS b FROM h GROUP BY 1, 2),
p AS (SELECT s, a / sum(a) OVER (PARTITION BY s) AS p, b / sum(b) OVER (PARTITION BY s) AS q FROM c), j AS (SELECT s, (sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2 AS js FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM events) AS n, round(quantile_cont(js, 0.95), 6) AS floor FROM j""")
def e15_split_floor(spark, d):
    return rounded(S.split_floor(t(spark, d, "events"), "event_id", "event_type"))


@query("""WITH a AS (SELECT o_orderdate >= TIMESTAMP '1997-01-01' AS s, strftime(o_orderdate, '%Y-%m') AS p, o_orderpriority AS c FROM orders), n AS (SELECT s, p, c, count(*) AS n FROM a GROUP BY 1, 2, 3), k AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS i FROM (SELECT DISTINCT s, p FROM n)),
x AS (SELECT s, i, c, n FROM n JOIN k USING (s, p)), st AS (SELECT s, i, c, n AS a, 0 AS b FROM x UNION ALL SELECT s, i - 1, c, 0, n FROM x), g AS (SELECT s, i, c, sum(a) AS a, sum(b) AS b FROM st WHERE i >= 1 AND i < (SELECT max(i) FROM k WHERE k.s = st.s) GROUP BY 1, 2, 3),
pq AS (SELECT s, i, a / sum(a) OVER (PARTITION BY s, i) AS p, b / sum(b) OVER (PARTITION BY s, i) AS q FROM g), j AS (SELECT (sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2 AS js FROM pq GROUP BY s, i),
ev AS (SELECT c, (sum(n) FILTER (WHERE s)) / (SELECT sum(n) FROM n WHERE s) AS p, (sum(n) FILTER (WHERE NOT s)) / (SELECT sum(n) FROM n WHERE NOT s) AS q FROM n GROUP BY 1), e AS (SELECT (sum(p * log2(2 * p / (p + q))) + sum(q * log2(2 * q / (p + q)))) / 2 AS event FROM ev)
SELECT round(event, 6) AS event, round((SELECT max(js) FROM j), 6) AS drift, event > (SELECT max(js) FROM j) AS beyond FROM e""")
def e16_drift_reference(spark, d):
    df = t(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(S.drift_reference(df, "month", "o_orderpriority", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")))


@query()
def e19_skill_validation(spark, d):
    orders = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("own"), F.collect_set("l_linestatus").alias("_s"))
    return rounded(S.skill_validation(orders.withColumn("inferred", F.concat("_s", F.array(F.lit("R")))), "l_orderkey", "own", "inferred"))


@query()
def t23_mutual_information(spark, d):
    return rounded(S.adjusted_mutual_information(t(spark, d, "embeddings").withColumn("other", F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 10).otherwise(F.col("label").cast("long"))), "label", "other"))


@query("""WITH r AS (SELECT o_orderkey, ['defense', 'none', 'trade', 'unclear', ''][CAST(1 + o_orderkey % 5 AS INT)] AS a, CASE WHEN o_custkey % 3 = 0 THEN 'trade' ELSE ['defense', 'none', 'trade', 'unclear', ''][CAST(1 + o_orderkey % 5 AS INT)] END AS b,
 ['low', 'medium', 'high', ''][CAST(1 + o_custkey % 4 AS INT)] AS l, ['low', 'medium', 'high', ''][CAST(1 + (o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 4 AS INT)] AS m FROM orders), p AS (SELECT * FROM r WHERE a <> '' AND b <> ''),
 c AS (SELECT a, b, count(*)::DOUBLE AS x FROM p GROUP BY 1, 2), n AS (SELECT sum(x) AS n, sum(x) FILTER (WHERE a = b) / sum(x) AS o FROM c), e AS (SELECT sum(r * s) / any_value(n * n) AS e FROM (SELECT a, sum(x) AS r FROM c GROUP BY 1) JOIN (SELECT b AS a, sum(x) AS s FROM c GROUP BY 1) USING (a), n),
 q AS (SELECT list_position(['low', 'medium', 'high'], l) AS i, list_position(['low', 'medium', 'high'], m) AS j FROM p WHERE a = b AND a NOT IN ('none', 'unclear') AND l <> '' AND m <> ''),
 k AS (SELECT count(*) AS n_level, sum((i - j) * (i - j))::DOUBLE AS seen FROM q), w AS (SELECT sum((x.i - y.j) * (x.i - y.j) * x.n * y.n)::DOUBLE AS chance FROM (SELECT i, count(*) AS n FROM q GROUP BY 1) x, (SELECT j, count(*) AS n FROM q GROUP BY 1) y)
SELECT CAST(n AS BIGINT) AS n, round(o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa, n_level, round(1 - seen * n_level / chance, 6) AS kappa_level FROM n, e, k, w""")
def e24_two_passes_levels(spark, d):
    """With the weighted kappa of intensity among rows of one channel."""
    rows, at = t(spark, d, "orders"), lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    label = at(["defense", "none", "trade", "unclear", ""], F.col("o_orderkey") % 5)
    first = rows.select("o_orderkey", label.alias("label"), at(["low", "medium", "high", ""], F.col("o_custkey") % 4).alias("level"))
    other = F.when(F.col("o_custkey") % 3 == 0, "trade").otherwise(label)
    second = rows.select("o_orderkey", other.alias("label"), at(["low", "medium", "high", ""], (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)) % 4).alias("level"))
    return rounded(S.two_passes(first, second, "o_orderkey", "label", "level"))
