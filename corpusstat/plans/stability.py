"""Queries of composition stability: size-matched distances, their nulls, and the jumps and quiet stretches of a series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.operators import composition as K
from corpusstat.operators import ordered as O
from corpusstat.operators import stretches as T
from corpusstat.plans.queries import query, rounded
from corpusstat.sources.readers import table as t


@query()
def e13_size_matched(spark, d):
    """Suppliers of returned lines against those of the others, by line status: the sides are of unequal size."""
    return rounded(K.size_matched(t(spark, d, "lineitem"), ["l_linestatus"], "l_suppkey", F.col("l_returnflag") == "R"))


def shipped(spark, d):
    """Lines as (dimension, day, value)."""
    lines = t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("value")) for n, c in (("flag", "l_returnflag"), ("supplier", "l_suppkey"))))).alias("v"))
    return lines.select("day", "v.*")


def by_volume(spark, d, stratum):
    """Lines of the days with the least (side true) and the most (false) lines, thirds being taken within a stratum of at least six days."""
    days = t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n")).withColumn("stratum", stratum)
    thirds = O.volume_thirds(days, ["stratum"], "day", "n").withColumn("_days", F.count("*").over(W.partitionBy("stratum"))).where("_days >= 6 and third <> 'middle'")
    sides = thirds.select("day", "stratum", (F.col("third") == "low").alias("low"))
    return shipped(spark, d).join(sides, "day")


@query()
def e14_volume_split(spark, d):
    """The composition of low-volume days against that of high-volume days, by flag and by supplier, with 1,000 shuffles of whole days."""
    return rounded(K.compared(by_volume(spark, d, F.lit("all")), ["dimension"], "day", "value", F.col("low")))


@query()
def e14_volume_split_within(spark, d):
    """The same with thirds and shuffles inside each quarter and weekday, which neither a trend nor a weekday's difference survives."""
    inside = F.concat_ws("|", F.date_trunc("quarter", "day").cast("date").cast("string"), F.weekday("day").cast("string"))
    return rounded(K.compared(by_volume(spark, d, inside), ["dimension"], "day", "value", F.col("low"), F.col("stratum")))


SERIES = """
WITH RECURSIVE d AS (SELECT o_orderpriority AS unit, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day) AS pos, avg(n) OVER b AS before, avg(n) OVER f AS after, count(*) OVER b + count(*) OVER f AS c, date_diff('day', min(day) OVER b, max(day) OVER f) AS span FROM d
  WINDOW b AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
cand AS (SELECT unit, pos, day, after / before AS ratio FROM a WHERE c = 14 AND span <= 20),
strong AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(abs(ln(ratio)), 12) DESC, pos) AS k FROM cand WHERE ratio >= 1.3 OR ratio <= 1 / 1.3::DOUBLE),
g AS (SELECT unit, k, [pos] AS taken FROM strong WHERE k = 1 UNION ALL SELECT r.unit, r.k, CASE WHEN len(list_filter(g.taken, lambda x: abs(x - r.pos) < 7)) = 0 THEN list_append(g.taken, r.pos) ELSE g.taken END FROM g JOIN strong r ON r.unit = g.unit AND r.k = g.k + 1),
jump AS (SELECT unit, unnest(taken) AS pos FROM (SELECT unit, arg_max(taken, k) AS taken FROM g GROUP BY 1))"""


def ratios(spark, d):
    days = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    places = days.select("unit", "day", F.row_number().over(W.partitionBy("unit").orderBy("day")).alias("at"))
    return O.jump_candidates(days, "unit", "day", "n", 7).join(places, ["unit", "day"])


@query(SERIES + "\nSELECT unit, day, round(ratio, 6) AS ratio FROM cand JOIN jump USING (unit, pos)")
def w7_jumps(spark, d):
    return rounded(T.jumps(ratios(spark, d), ["unit"], "at", "ratio", 1.3, 7).select("unit", "day", "ratio"))


@query(SERIES + """,
quiet AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY pos) AS k FROM cand WHERE ratio BETWEEN 1 / 1.1::DOUBLE AND 1.1 AND NOT EXISTS (SELECT 1 FROM jump j WHERE j.unit = cand.unit AND abs(j.pos - cand.pos) < 14)),
h AS (SELECT unit, k, pos AS last, true AS took FROM quiet WHERE k = 1 UNION ALL SELECT q.unit, q.k, CASE WHEN q.pos - h.last >= 14 THEN q.pos ELSE h.last END, q.pos - h.last >= 14 FROM h JOIN quiet q ON q.unit = h.unit AND q.k = h.k + 1)
SELECT unit, day, round(ratio, 6) AS ratio FROM quiet JOIN h USING (unit, k) WHERE took""")
def w8_placebos(spark, d):
    rows = ratios(spark, d)
    return rounded(T.placebos(rows, T.jumps(rows, ["unit"], "at", "ratio", 1.3, 7), ["unit"], "at", "ratio", 1.1, 7).select("unit", "day", "ratio"))
