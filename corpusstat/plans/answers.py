"""Queries of prompts, model answers, titles' first stage, place terms and search rules. Where a function reads what the tables don't have (answers of a model, titles of postings), each order or part
gets one of several made ones by its number, and the SQL says what is to come of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.functions import prepare as P
from corpusstat.operators import wildcards as K
from corpusstat.plans.queries import query, rounded
from corpusstat.sources.readers import table as t

quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def expected(table: str, key: str, names: list[str], rows: list[tuple]) -> str:
    """SQL that gives each row of the table the made row of its number."""
    values = ", ".join(f"({i}, {', '.join(map(quoted, r))})" for i, r in enumerate(rows))
    return f"WITH v(i, {', '.join(names)}) AS (VALUES {values}) SELECT {key}, {', '.join(names)} FROM {table} JOIN v ON {key} % {len(rows)} = i"


def made(spark, d, table: str, key: str, values: list):
    """The table's keys, each with the made value of its number."""
    return t(spark, d, table).select(key, F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int")).alias("made"))


CONTEXT = "trim(regexp_replace(substr(plain, greatest(instr(lower(plain), {0}) - 250, 1), instr(lower(plain), {0}) - greatest(instr(lower(plain), {0}) - 250, 1) + length({0}) + 250), '\\s+', ' ', 'g'))"


@query(rf"""
WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g')) AS plain FROM documents),
b AS (SELECT doc_id, plain, list_filter(['zo', 'tion', 'eau', 'qx'], lambda m: instr(lower(plain), m) - 1 >= 100)[1:3] AS late FROM a)
SELECT doc_id, md5(substr(plain, 1, 200) || CASE WHEN len(late) > 0 THEN chr(10) || '[...]' || chr(10) || array_to_string(list_transform(late, lambda m: {CONTEXT.format("m")}), chr(10) || '[...]' || chr(10)) ELSE '' END) AS prompt FROM b""")
def x9_prompt_text(spark, d):
    matched = F.array(*map(F.lit, ["zo", "tion", "eau", "qx"]))
    return t(spark, d, "documents").select("doc_id", F.md5(P.prompt_text(F.col("text"), matched, 200)).alias("prompt"))


CHANNELS, SECTORS = ["defense", "diversification", "none"], {"aerospace": "defense"}
#: An answer, and its channel, intensity, evidence, subtype and what it was mapped from.
ANSWERS = [
    ('{"channel": "Defence", "intensity": "HIGH", "evidence": "tanks"}', "defense", "high", "tanks", None, None),
    ('Sure: {"channel": "sovereign_cloud", "intensity": "low", "evidence": "cloud"} Done.', "diversification", "low", "cloud", "sovereign-tech", "sovereign cloud"),
    ('{"channel": "aerospace", "intensity": "medium", "evidence": ""}', "defense", "medium", "", None, "aerospace"),
    ('{"channel": "none", "intensity": "high", "evidence": "x"}', "none", "none", "x", None, None),
    ('{"channel": "defense", "intensity": "huge", "evidence": "x"}', None, None, None, None, None),
    ('{"channel": "cooking", "intensity": "low"}', None, None, None, None, None),
    ('{"channel": "diversification", "intensity": "low", "evidence": "a", "subtype": "Supply-Side"}', "diversification", "low", "a", "supply-side", None),
    ('{"channel": "defense", "intensity": "low", "evidence": "broken " quote"}', "defense", "low", 'broken " quote', None, None),
    ("no answer", None, None, None, None, None),
    (None, None, None, None, None, None),
]


@query(expected("orders", "o_orderkey", ["channel", "intensity", "evidence", "subtype", "mapped_from"], [a[1:] for a in ANSWERS]))
def x10_parsed_answer(spark, d):
    rows = made(spark, d, "orders", "o_orderkey", [a[0] for a in ANSWERS])
    return rows.select("o_orderkey", P.parsed_answer(F.col("made"), CHANNELS, SECTORS).alias("a")).select("o_orderkey", "a.*")


TITLES = [('{"title": "Senior  Nurse"}', "Senior Nurse"), ('Title: {"title": "UNKNOWN"}', None), ('broken "title": "Cook", and more', "Cook"), ("{}", None), (None, None), ('{"title": " "}', None), ('{"title": "' + "x" * 130 + '"}', "x" * 120)]


@query(expected("orders", "o_orderkey", ["title"], [a[1:] for a in TITLES]))
def x11_parsed_title(spark, d):
    rows = made(spark, d, "orders", "o_orderkey", [a[0] for a in TITLES])
    return rows.select("o_orderkey", P.parsed_title(F.col("made")).alias("title"))


#: A title of a posting in Lund, and what the first stage leaves.
RAW = [("Nurse (m/w/d)", "Nurse"), ("AB-12-X Nurse - Acme GmbH", "Nurse"), ("Nurse - Night shift - Lunds kommun", "Nurse - Night shift"), ("Nurse  -  Lund", "Nurse"), ("Cook - 80 - 100%", "Cook - 80 - 100%"), ("Driver | Omegapoint", "Driver"), ("Driver ABC12345", "Driver"), ("", ""), (None, ""), ("Chef - Malmö, Lund", "Chef"), ("Chef - Kitchen", "Chef - Kitchen")]


@query(expected("orders", "o_orderkey", ["title"], [a[1:] for a in RAW]))
def x12_clean_title(spark, d):
    rows = made(spark, d, "orders", "o_orderkey", [a[0] for a in RAW])
    return rows.select("o_orderkey", P.clean_title(F.col("made"), F.lit("Lund, Skåne"), F.array(F.lit("omegapoint"))).alias("title"))


LANGUAGES = [("Ingénieur réseau", "French"), ("Verkäufer und Fahrer", "German"), ("Butik säljare på", "Swedish"), ("Senior engineer", ""), ("Chef de projet", "French,Swedish"), (None, ""), ("Chefin", ""), ("Größe", "German")]


@query(expected("orders", "o_orderkey", ["languages"], [a[1:] for a in LANGUAGES]))
def x19_title_languages(spark, d):
    rows = made(spark, d, "orders", "o_orderkey", [a[0] for a in LANGUAGES])
    return rows.select("o_orderkey", F.array_join(P.title_languages(F.col("made")), ",").alias("languages"))


LOCATIONS = [("Athens, Georgia", ""), ("Athens, Greece", "athens"), ("Thessaloníki (center)", "thessaloniki"), ("Athensville", ""), (None, ""), ("Patras / Athens", "athens"), ("PATRAS", "patras")]


@query(expected("orders", "o_orderkey", ["place"], [a[1:] for a in LOCATIONS]))
def x22_place_term(spark, d):
    rows = made(spark, d, "orders", "o_orderkey", [a[0] for a in LOCATIONS])
    return rows.select("o_orderkey", P.place_term(F.col("made"), ["athens", "thessaloniki", "patras"], {"athens": r"\b(georgia|ohio)\b"}).alias("place"))


OCCURRENCES = [("nothing here", "none"), ("a lithium battery", "all"), ("lithium battery and lithium grease", "all"), ("lithium battery" + " x" * 60 + " lithium grease", "some"), ("lithium alone", "some"), (None, "none"), ("LITHIUM in a BATTERY " * 40, "all"), ("lithium battery therapy", "some")]


@query(expected("orders", "o_orderkey", ["found"], [a[1:] for a in OCCURRENCES]))
def x27_every_occurrence(spark, d):
    rows = made(spark, d, "orders", "o_orderkey", [a[0] for a in OCCURRENCES])
    return rows.select("o_orderkey", P.every_occurrence(F.col("made"), "lithium", "batter", "therapy").alias("found"))


@query(r"""
WITH a AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'the src1' ELSE coalesce(source, '') END AS ti, coalesce(text, '') AS de FROM documents), b AS (SELECT *, lower(ti || ' ' || de) AS whole FROM a)
SELECT doc_id, regexp_matches(ti, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])the([^\p{L}\p{M}\p{N}\p{Pc}]|$)') AS title, regexp_matches(de, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])the([^\p{L}\p{M}\p{N}\p{Pc}]|$)') AS description,
 regexp_matches(substr(de, 1, 1000), '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])the([^\p{L}\p{M}\p{N}\p{Pc}]|$)') AS early, contains(whole, 'the') AS "substring", list_contains(string_split_regex(whole, '\s+'), 'the') AS spaced FROM b""")
def x30_search_hits(spark, d):
    """How five search rules find a word in whole texts; the source stands for the title, which has the word where it is src1."""
    rows = t(spark, d, "documents").select("doc_id", F.when(F.col("source") == "src1", "the src1").otherwise(F.col("source")).alias("title"), "text")
    hits = rows.select("doc_id", P.search_hits(F.col("title"), F.col("text"), "the").alias("h")).select("doc_id", "h.*")
    return hits


@query(r"""
WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS source, concat(c_mktsegment, ' for ', o_orderstatus) AS text FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 > 0),
c AS (SELECT month, source, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(lower(text), '\b(building|machinery)\b')) AS with_word FROM a GROUP BY 1, 2),
m AS (SELECT CAST(unnest(range((SELECT min(month) FROM c), (SELECT max(month) FROM c) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT m.month, s.source, coalesce(texts, 0) AS texts, coalesce(with_word, 0) AS with_word FROM m CROSS JOIN (SELECT DISTINCT source FROM c) s LEFT JOIN c ON c.month = m.month AND c.source = s.source""")
def pb14_keyword_months(spark, d):
    customer = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = t(spark, d, "orders").where("o_orderkey % 5 > 0").join(customer, "o_custkey", "left")
    return rounded(K.keyword_months(rows, F.to_date("o_orderdate"), "o_orderpriority", F.concat_ws(" ", "c_mktsegment", F.lit("for"), "o_orderstatus"), ["BUILDING", "machinery"]))
