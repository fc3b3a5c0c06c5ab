"""Places and running sums within groups of any size, without a task that holds a group.

Rows are cut into ranges of about equal size by group and order; each range's own running sums get what the ranges before it hold, from a table of
one row a range and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.llm.blocks import Scratch


def running(tables: Scratch, df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with two columns for each of the sums (of columns that are whole numbers or decimals): before_x, over the rows of its group that stand before
    it, and all_x, over its group. Nulls are groups, and stand first in an order. Rows that tie wholly get the places of the ties in no
    fixed order. The ranges are written once (table `ranged`), so the sums and the rows come from the same cut even if executors are lost."""
    keys = [F.col(c) for c in group]
    named = {f"_o{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)} | {f"_v_{x}": v for x, v in sums.items()}
    # A random number from a fixed seed cuts many equal rows, which a range of values can't.
    cut = df.withColumns(named).withColumn("_salt", F.rand(7)).repartitionByRange(*keys, *(F.col(f"_o{i}") for i in range(len(order))), F.col("_salt"))
    rows = tables.write("ranged", cut.withColumn("_range", F.spark_partition_id()).drop("_salt"))
    each = rows.groupBy(*group, "_range").agg(*(F.sum(f"_v_{x}").alias(f"_s_{x}") for x in sums))
    whole = W.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = each.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_range").alias("_at"),
                         *(f(x) for x in sums for f in (lambda x: F.sum(f"_s_{x}").over(before).alias(f"_b_{x}"), lambda x: F.sum(f"_s_{x}").over(whole).alias(f"all_{x}"))))
    inside = W.partitionBy(*group, "_range").orderBy(*(f"_o{i}" for i in range(len(order)))).rowsBetween(W.unboundedPreceding, 0)
    upto = rows.withColumns({f"_u_{x}": F.sum(f"_v_{x}").over(inside) for x in sums})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col("_range") == F.col("_at"))
    out = upto.join(starts, on)
    places = {f"before_{x}": F.col(f"_u_{x}") - F.col(f"_v_{x}") + F.coalesce(F.col(f"_b_{x}"), F.lit(0)) for x in sums}
    return out.withColumns(places).drop("_range", "_at", *(f"_g{i}" for i in range(len(group))), *(f"_o{i}" for i in range(len(order))), *(f"{p}{x}" for x in sums for p in ("_v_", "_u_", "_b_")))
