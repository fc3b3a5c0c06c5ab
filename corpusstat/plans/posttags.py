"""The rules over tags by what a posting says, on tags and postings put together from pieces by each order's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.operators import rules as R
from corpusstat.plans.queries import query
from corpusstat.sources.readers import table as t

PIECES = ["We build trains", "You will maintain the SecNumCloud label", "Knowledge of EUCS and GDPR", "Acme is a leading SecNumCloud provider", "reduce our dependence on one region", "a European cloud (ISO, EUCS, HDS)", "ensure quality/EUCS"]
EVIDENCE = ["AWS, GCP, OVHcloud, Scaleway", "You run AWS, GCP, OVHcloud, Bleu", "audit of EUCS", "", "AWS, Scaleway", "a, b, c, one two three four five"]
CHANNEL, SUBTYPE, LEVEL, TERMS = ["diversification", "none", "trade compliance", "defense"], ["supply-side", "", "sovereign-tech"], ["low", "none", "medium"], ["EUCS", "ovhcloud", "azure", "SecNumCloud", "bleu"]
KEY = "(o_orderkey * 7 + o_custkey * 3)"
pick = lambda values, n, by: "element_at(array(" + ", ".join(f"'{v}'" for v in values) + f"), cast(1 + ({KEY} div {by}) % {n} as int))"
pick_sql = lambda values, n, by: "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(1 + ({KEY} // {by}) % {n} AS INT)]"
FIELDS = {"channel": (CHANNEL, 4, 1), "subtype": (SUBTYPE, 3, 5), "intensity": (LEVEL, 3, 2), "evidence": (EVIDENCE, 6, 3), "term": (TERMS, 5, 4), "one": (PIECES, 7, 2), "two": (PIECES, 7, 11), "three": (PIECES, 7, 29)}
LABEL = '{"channel": "sovereign-cloud", "intensity": "high"}'
within = lambda c, before, after: f"regexp_extract({c}, '(?i)[^{before}]*?(?:secnumcloud|eucs)[^{after}]*')"


@query(f"""
WITH a AS (SELECT o_orderkey AS id, o_orderkey % 13 > 0 AS ok, {', '.join(f"{pick_sql(*v)} AS {k}" for k, v in FIELDS.items())}, CASE WHEN o_orderkey % 2 = 0 THEN '{LABEL}' ELSE '' END AS raw FROM orders),
b AS (SELECT *, one || '. ' || two || '; ' || three AS text, lower(term) AS low FROM a), c AS (SELECT *, evidence || ' ' || text AS hay, {within('text', '.;•\n', '.;•\n')} AS s FROM b),
d AS (SELECT *, CASE WHEN s <> '' THEN substr(s, 1, 400) WHEN regexp_matches(evidence, '(?i)secnumcloud|eucs') THEN evidence ELSE '' END AS sentence, len(regexp_extract_all({within('text', '(.;•\n', ').;•\n')}, ',|\\bor\\b|\\band\\b|/')) >= 2 AS many FROM c),
e AS (SELECT *, CASE WHEN NOT ok AND raw <> '' THEN 'R0 cloud label as channel' WHEN NOT ok THEN NULL
 WHEN channel = 'diversification' AND (subtype = 'supply-side' OR (subtype = '' AND NOT regexp_matches(hay, '(?i){R.SOVEREIGN}'))) AND NOT regexp_matches(hay, '(?i){R.SUPPLY}') THEN 'R1 supply-side without its wording'
 WHEN channel IN ('none', 'trade compliance') AND low IN ('eucs', 'secnumcloud') THEN 'R2 certificate in a role'
 WHEN channel = 'diversification' AND subtype = 'sovereign-tech' AND length(evidence) - length(replace(evidence, ',', '')) >= 3 AND NOT regexp_matches(evidence, '(?i){R.WORK}') AND NOT contains(evidence, 'five') AND low IN ({', '.join(f"'{p}'" for p in R.PROVIDERS)}) THEN 'R3 provider in a list of tools' END AS rule,
 CASE WHEN sentence = '' THEN 'low' WHEN regexp_matches(sentence, '(?i){R.EMPLOYER}') THEN CASE WHEN intensity = 'none' THEN 'low' ELSE intensity END WHEN regexp_matches(sentence, '(?i){R.DUTY}') AND NOT regexp_matches(sentence, '(?i){R.WISHES}') AND NOT many THEN 'high' ELSE 'low' END AS found FROM d)
SELECT id, CASE WHEN rule[1:2] IN ('R0', 'R2') THEN 'diversification' WHEN rule[1:2] IN ('R1', 'R3') THEN 'none' ELSE channel END AS channel, CASE rule[1:2] WHEN 'R0' THEN 'high' WHEN 'R1' THEN 'none' WHEN 'R2' THEN found WHEN 'R3' THEN 'none' ELSE intensity END AS intensity,
 CASE WHEN rule[1:2] IN ('R0', 'R2') THEN 'sovereign-tech' WHEN rule[1:2] IN ('R1', 'R3') THEN '' ELSE subtype END AS subtype, rule AS post_rule FROM e""")
def x28_post_rules(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 13 > 0).alias("ok"), *(F.expr(pick(*v)).alias(k) for k, v in FIELDS.items()), F.when(F.col("o_orderkey") % 2 == 0, LABEL).otherwise("").alias("raw"))
    rows = rows.withColumns({"text": F.concat("one", F.lit(". "), "two", F.lit("; "), "three"), "terms": F.array("term")})
    return R.ruled(rows, R.post_rules()).select("id", "channel", "intensity", "subtype", "post_rule")
