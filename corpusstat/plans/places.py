"""Queries of points in areas and of labels in long lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusstat.functions import prepare as Q
from corpusstat.operators import places as A
from corpusstat.operators import profiles as P
from corpusstat.operators import title_rules as R
from corpusstat.operators import titles as T
from corpusstat.plans.queries import query
from corpusstat.sources.readers import table as t

#: A concave outline and a hole, in tenths of a nation's size.
OUTLINE, HOLE = ((10, 1), (4, 4), (1, 10), (-4, 5), (-10, -1), (-3, -4), (1, -10), (5, -5)), ((2, 1), (-1, 2), (-2, -1), (1, -2))
SIZE = "(0.06 + (n_nationkey * 7 % 5) / 50.0)"


def nation_areas(spark, d):
    """An area a nation, around a point of a grid of five by five; some overlap."""
    ring = lambda corners: "array(" + ", ".join(f"array(mid_x + size * {x}, mid_y + size * {y})" for x, y in corners) + ")"
    rows = t(spark, d, "nation").selectExpr("n_name as id", "(n_nationkey % 5) * 2.0D as mid_x", "(n_nationkey div 5) * 2.0D as mid_y", f"cast({SIZE} as double) as size")
    return rows.select("id", F.expr(f"array({ring(OUTLINE)}, {ring(HOLE)})").alias("rings"))


ring_sql = lambda corners: "[" + ", ".join(f"[mid_x + size * {x}, mid_y + size * {y}]" for x, y in corners) + "]"


@query(f"""
WITH n AS (SELECT n_name AS id, (n_nationkey % 5) * 2.0::DOUBLE AS mid_x, (n_nationkey // 5) * 2.0::DOUBLE AS mid_y, CAST((0.06 + (n_nationkey * 7 % 5) / 50.0::DOUBLE) AS DOUBLE) AS size FROM nation),
r AS (SELECT id, unnest([{ring_sql(OUTLINE)}, {ring_sql(HOLE)}]) AS r FROM n), c AS (SELECT id, r, unnest(range(1, len(r) + 1)) AS i FROM r),
e AS (SELECT id, r[i][1] AS ax, r[i][2] AS ay, r[i % len(r) + 1][1] AS bx, r[i % len(r) + 1][2] AS b_y FROM c),
p AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 - 1 AS x, l_suppkey % 1009 / 100.0::DOUBLE - 1 AS y FROM lineitem), q AS (SELECT DISTINCT x, y FROM p),
m AS (SELECT x, y, id, sum(CASE WHEN (ay > y) <> (b_y > y) THEN CASE WHEN x < (bx - ax) * (y - ay) / (b_y - ay) + ax THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1 AS inside,
  min(sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (b_y - ay), 2))) AS d FROM (SELECT *, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS u FROM q, e) GROUP BY 1, 2, 3),
b AS (SELECT x, y, min(id) FILTER (WHERE inside) AS hit, arg_min(id, d) FILTER (WHERE d <= 0.15) AS near FROM m GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, coalesce(hit, near) AS area, CASE WHEN hit IS NOT NULL THEN 'inside' WHEN near IS NOT NULL THEN 'nearest' ELSE 'unplaced' END AS method FROM p LEFT JOIN b USING (x, y)""")
def j9_inside_areas(spark, d):
    points = t(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("line"), (F.col("l_extendedprice") / 10000 - 1).alias("x"), (F.col("l_suppkey") % 1009 / 100.0 - 1).alias("y"))
    out = A.inside_areas(points, nation_areas(spark, d), "line", "x", "y")
    return out.select("line.l_orderkey", F.col("line.l_linenumber").cast("long").alias("l_linenumber"), "area", "method")


@query("""
WITH l AS (SELECT lower(trim(p_name)) AS label, min(p_partkey) AS code FROM part GROUP BY 1), x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'the ' || p_name || ' of ' || c_name WHEN 2 THEN substr(p_name, 1, CAST(4 + c_custkey % 9 AS INT)) ELSE c_name END AS words
  FROM customer LEFT JOIN part ON p_partkey = c_custkey), q AS (SELECT DISTINCT words, lower(trim(words)) AS q FROM x WHERE trim(words) <> ''),
m AS (SELECT words, label, code, row_number() OVER (PARTITION BY words ORDER BY q = label DESC, length(label) DESC, label) AS rn FROM q JOIN l ON contains(q, label) OR contains(label, q))
SELECT c_custkey, x.words, m.label AS p_name, m.code AS p_partkey FROM x LEFT JOIN m ON m.words = x.words AND rn = 1""")
def j7_match_many_labels(spark, d):
    """Names of all parts as labels, in, around and equal to texts made of them."""
    rows = t(spark, d, "customer").join(t(spark, d, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("_name")), "c_custkey", "left")
    kind = F.col("c_custkey") % 4
    words = F.when(kind == 0, F.upper("_name")).when(kind == 1, F.concat(F.lit("the "), "_name", F.lit(" of "), "c_name")).when(kind == 2, F.substring(F.col("_name"), F.lit(1), (4 + F.col("c_custkey") % 9).cast("int"))).otherwise(F.col("c_name"))
    return P.match_labels(rows.select("c_custkey", words.alias("words")), "words", t(spark, d, "part"), "p_name", "p_partkey")


#: What is put behind a part's name, and the rules that take it off.
TAILS = {0: ("concat(' in ', n_name)", "place"), 1: ("concat(' to ', p_brand)", "employer"), 2: ("' (80%)'", "filler,tidy"), 3: ("' ab 01.08.2025'", "start,tidy"), 4: ("', Kennzahl 4711 und mehr'", "reference"), 5: ("' (m/f) im Raum'", "area")}


@query(f"""SELECT p_partkey, p_name AS clean, CASE p_partkey % 6 {' '.join(f"WHEN {k} THEN '{rule}'" for k, (_, rule) in TAILS.items())} END AS rules FROM part""")
def x13_clean_titles(spark, d):
    """Titles of both stages, with the board's own places and common words. All that is put behind the names comes off, by the rule meant for it."""
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("_k"), "n_name")
    tail = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {made}" for k, (made, _) in TAILS.items()) + " END"
    rows = t(spark, d, "part").join(F.broadcast(nation), F.col("p_partkey") % 25 == F.col("_k"))  # 25 rows
    rows = rows.select("p_partkey", F.concat("p_name", F.expr(tail)).alias("title"), F.concat("n_name", F.lit(", all")).alias("location"))
    rows = rows.withColumn("title", Q.clean_title(F.col("title"), F.lit("")))
    out = R.clean_titles(rows, "title", "location", T.board_places(rows, "location"), T.common_words(T.title_case(rows, "title")))
    return out.select("p_partkey", "clean", F.array_join("rules", ",").alias("rules"))
