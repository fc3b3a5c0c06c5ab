"""Choices among candidates that keep their distance, for any number of units at once.

Choosing the strongest first, each away from those taken, gives the same as rounds in which every candidate that is the strongest within its reach is taken
and strikes its neighbours. Choosing from left to right is a chain, whose members are found by doubling jumps. Either way no list of candidates
comes to the driver: it asks once a round whether any are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.tables import Scratch


def strongest_apart(candidates: DataFrame, unit: list[str], at: str, strength: Column, span: int) -> DataFrame:
    """The candidates (rows with their columns) that remain when, per unit, the strongest are taken first (ties: the first by `at`), each at least `span` from all taken before.

    `at` is a whole number (a day's number or place), distinct within a unit. Null places or strengths are left out. A round is one window over places
    within reach; of n candidates in one reach one is taken a round, so rounds are as many as the longest run of ever weaker neighbours."""
    tables = Scratch(candidates.sparkSession, "apart")
    left = candidates.withColumns({"_at": F.col(at).cast("long"), "_s": strength.cast("double")}).where("_at is not null and _s is not null")
    left, taken, turn = tables.write("left", left), None, 0
    reach = W.partitionBy(*unit).orderBy("_at").rangeBetween(-(span - 1), span - 1)
    own = F.struct("_s", -F.col("_at"))
    while not left.isEmpty():
        marked = left.withColumn("_top", F.max(own).over(reach) == own)
        marked = tables.write("marked", marked.withColumn("_struck", F.max("_top").over(reach)))
        new = tables.write(f"taken-{turn}", marked.where("_top").drop("_top", "_struck"))
        taken = new if taken is None else taken.unionByName(new)
        left = tables.write("left", marked.where("not _struck").drop("_top", "_struck"))
        turn += 1
    return (left if taken is None else taken).drop("_at", "_s")


def chained(candidates: DataFrame, unit: list[str], at: str, gap: int) -> DataFrame:
    """The candidates taken from left to right per unit, each at least `gap` after the last one taken.

    Each place knows the next one that may follow it. The chain from a unit's first place is found by doubling: the places known so far, and those as many
    steps further as the links now reach. So n links take log2(n) rounds. `at` is a whole number, distinct within a unit; null places are left out."""
    tables = Scratch(candidates.sparkSession, "chained")
    rows = tables.write("rows", candidates.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("long")))
    after = W.partitionBy(*unit).orderBy("_at").rangeBetween(gap, W.unboundedFollowing)
    links = tables.write("links", rows.select(*unit, "_at", F.min("_at").over(after).alias("_to")).where("_to is not null"))
    known = rows.groupBy(*unit).agg(F.min("_at").alias("_at"))
    same = lambda a, b: [F.col(f"{a}.{u}").eqNullSafe(F.col(f"{b}.{u}")) for u in unit]
    both = lambda conds, more: more if not conds else conds[0] & both(conds[1:], more)
    while not links.isEmpty():
        a, b = known.alias("a"), links.alias("b")
        further = a.join(b, both(same("a", "b"), F.col("a._at") == F.col("b._at"))).select(*(F.col(f"a.{u}") for u in unit), F.col("b._to").alias("_at"))
        known = tables.write("known", known.unionByName(further).distinct())
        x, y = links.alias("x"), links.alias("y")
        twice = x.join(y, both(same("x", "y"), F.col("x._to") == F.col("y._at"))).select(*(F.col(f"x.{u}") for u in unit), F.col("x._at").alias("_at"), F.col("y._to").alias("_to"))
        links = tables.write("links", twice)
    r, k = rows.alias("r"), known.alias("k")
    return r.join(k, both(same("r", "k"), F.col("r._at") == F.col("k._at")), "left_semi").drop("_at")


def jumps(candidates: DataFrame, unit: list[str], at: str, ratio: str, least: float, span: int) -> DataFrame:
    """Jumps of at least the ratio `least` (or its inverse), the strongest first, each `span` places from those taken."""
    strong = candidates.where((F.col(ratio) >= least) | (F.col(ratio) <= 1 / least))
    return strongest_apart(strong, unit, at, F.round(F.abs(F.log(ratio)), 12), span)


def placebos(candidates: DataFrame, jumped: DataFrame, unit: list[str], at: str, ratio: str, most: float, span: int) -> DataFrame:
    """Quiet stretches: candidates whose ratio is within 1/most to most, at least 2 * span places from every jump of their unit and, from left to right,
    from the last one taken."""
    marks = candidates.withColumn("_jump", F.lit(0)).unionByName(jumped.select(*unit, at).withColumn("_jump", F.lit(1)), allowMissingColumns=True)
    reach = W.partitionBy(*unit).orderBy(F.col(at).cast("long")).rangeBetween(-(2 * span - 1), 2 * span - 1)
    free = marks.withColumn("_near", F.max("_jump").over(reach)).where("_near = 0 and _jump = 0").drop("_near", "_jump")
    return chained(free.where(F.col(ratio).between(1 / most, most)), unit, at, 2 * span)
