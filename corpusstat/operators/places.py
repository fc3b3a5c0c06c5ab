"""Points in areas as a join of grid cells.

An area's edges are put into the cells that they touch. A cell without edges lies wholly inside or outside of an area, so the cell answers for its points. In a cell with edges it is known whether
the centre is inside; a point of the cell differs from it if the way from the centre to the point crosses the cell's edges an odd number of times. Where rounding may tell a crossing wrong, because an
edge runs through the point or through the bend of the way, the edges of the point's whole row of cells are counted instead. All of it is Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusstat.tables import Scratch

#: Cells along the longer side of the areas' box, at most; by how much of a cell an edge is taken to touch its neighbours; and how near to a point, as a part of the largest coordinate,
#: an edge is when rounding may put it on the wrong side (some 1e-15 does).
ACROSS, SLACK, DOUBT = 512, 1e-9, 1e-12


def edges_of(areas: DataFrame) -> DataFrame:
    """(area, ax, ay, bx, by) of all rings; a ring's last corner meets its first."""
    ring = areas.select(F.col("id").cast("string").alias("area"), F.explode("rings").alias("r"))
    corner = ring.select("area", "r", F.posexplode("r").alias("i", "a"))
    b = F.get("r", F.when(F.col("i") + 1 < F.size("r"), F.col("i") + 1).otherwise(0))
    return corner.select("area", F.get("a", 0).cast("double").alias("ax"), F.get("a", 1).cast("double").alias("ay"), F.get(b, 0).cast("double").alias("bx"), F.get(b, 1).cast("double").alias("by"))


def touched(edges: DataFrame, g: float) -> DataFrame:
    """edges with a row for each cell (cx, cy) that they touch: row by row of the grid, the columns between the edge's ends within that row."""
    cell = lambda v: F.floor(v)
    low, high = F.least("ay", "by") / g - SLACK, F.greatest("ay", "by") / g + SLACK
    rows = edges.withColumn("cy", F.explode(F.sequence(cell(low), cell(high))))
    # least() and greatest() pass over nulls, so a level edge is told apart first
    part = lambda y: F.when(F.col("ay") != F.col("by"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y * g - F.col("ay")) / (F.col("by") - F.col("ay")))))
    x = lambda p, flat: F.col("ax") + F.coalesce(p, F.lit(flat)) * (F.col("bx") - F.col("ax"))
    ends = (x(part(F.col("cy") - SLACK), 0.0), x(part(F.col("cy") + 1 + SLACK), 1.0))
    return rows.withColumn("cx", F.explode(F.sequence(cell(F.least(*ends) / g - SLACK), cell(F.greatest(*ends) / g + SLACK))))


def covered(edges: DataFrame, g: float) -> DataFrame:
    """(cx, cy, areas): per cell the areas that have edges in it or hold it whole, each with odd (the centre is inside) and its edges there."""
    ends = F.struct("ax", "ay", "bx", "by")
    bounds = touched(edges, g).groupBy("area", "cx", "cy").agg(F.collect_list(ends).alias("edges"))
    # Where the middle line of a row of cells meets the edges, from left to right, with the centres of cells among them.
    my = (F.col("cy") + 0.5) * g
    low, high = F.floor(F.least("ay", "by") / g - 1), F.ceil(F.greatest("ay", "by") / g + 1)
    lines = edges.withColumn("cy", F.explode(F.sequence(low, high))).where((F.col("ay") > my) != (F.col("by") > my))
    crossing = lines.select("area", "cy", ((F.col("bx") - F.col("ax")) * (my - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"), F.lit(1).alias("cross"), F.lit(None).cast("long").alias("cx"), F.lit(None).cast("long").alias("until"))
    along = W.partitionBy("area", "cy").orderBy("cx")
    gaps = bounds.select("area", "cy", "cx", F.lead("cx").over(along).alias("next"))
    centre = lambda c: (c + 0.5) * g
    own = gaps.select("area", "cy", centre(F.col("cx")).alias("x"), F.lit(0), "cx", F.col("cx"))
    between = gaps.where("next > cx + 1").select("area", "cy", centre(F.col("cx") + 1).alias("x"), F.lit(0), F.col("cx") + 1, F.col("next") - 1)
    marks = crossing.union(own).union(between)
    # crossings to the right of a centre: strictly, so equal ones stand before it
    right = F.sum("cross").over(W.partitionBy("area", "cy").orderBy(F.desc("x"), "cross").rowsBetween(W.unboundedPreceding, 0))
    known = marks.withColumn("odd", F.coalesce(right, F.lit(0)) % 2 == 1).where("cx is not null")
    cells = known.withColumn("cx", F.explode(F.sequence("cx", "until"))).join(bounds, ["area", "cx", "cy"], "left").where("odd or edges is not null")
    return cells.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("area", "odd", F.coalesce("edges", F.array().cast("array<struct<ax: double, ay: double, bx: double, by: double>>")).alias("edges")))).alias("areas"))


def crosses(e: Column, mx: Column, my: Column, x: Column, y: Column) -> Column:
    """How often an edge is crossed from (mx, my) along the row to x, then along the column to y (0 to 2); ends of an edge belong to one of two neighbours."""
    ax, ay, bx, by = (e[c] for c in ("ax", "ay", "bx", "by"))
    at = (bx - ax) * (my - ay) / (by - ay) + ax
    up = (by - ay) * (x - ax) / (bx - ax) + ay
    flat = F.when((ay > my) != (by > my), ((mx < at) != (x < at)).cast("int")).otherwise(0)
    steep = F.when((ax > x) != (bx > x), ((my < up) != (y < up)).cast("int")).otherwise(0)
    return flat + steep


def doubtful(e: Column, mx: Column, my: Column, x: Column, y: Column, tol: float) -> Column:
    """Whether an edge runs within tol of (x, y) or of (x, my), the bend of the way to it."""
    ax, ay, bx, by = (e[c] for c in ("ax", "ay", "bx", "by"))
    near = lambda v, w: F.abs(v - w) <= tol
    up = (by - ay) * (x - ax) / (bx - ax) + ay
    level = lambda h: F.when((ay > h) != (by > h), near(x, (bx - ax) * (h - ay) / (by - ay) + ax)).otherwise(False)
    corner = near(x, ax) & (near(y, ay) | near(my, ay)) | near(x, bx) & (near(y, by) | near(my, by))
    return level(y) | level(my) | F.when((ax > x) != (bx > x), near(y, up) | near(my, up)).otherwise(False) | corner


def counted(asked: DataFrame, edges: DataFrame, g: float) -> DataFrame:
    """(x, y, exact): the least of the areas that are asked about (x, y, cy, area) and hold the point, by all of their edges in its row of cells."""
    low, high = F.floor(F.least("ay", "by") / g - SLACK), F.floor(F.greatest("ay", "by") / g + SLACK)
    rows = edges.withColumn("cy", F.explode(F.sequence(low, high)))
    met = asked.distinct().join(rows, ["area", "cy"])
    right = F.when((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")), (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).cast("int")).otherwise(0)
    return met.groupBy("x", "y", "area").agg((F.sum(right) % 2 == 1).alias("odd")).where("odd").groupBy("x", "y").agg(F.min("area").alias("exact"))


def inside_areas(points: DataFrame, areas: DataFrame, key: str, x: str, y: str, near: float = 0.15) -> DataFrame:
    """(key, area, method) of each point: the area that holds it (even-odd rule over its rings; of several the least id), else the nearest within `near`
    of a boundary (ties: the least id), else null and 'unplaced'. Points without a place are unplaced; keys may repeat; areas of any number and detail.

    A point on an edge is told by the sign of x < (bx - ax) * (y - ay) / (by - ay) + ax, in doubles, over the edges with one end above it, as SQL would.

    A cell is as wide as `near`, or wider where the areas' box would have more than ACROSS cells a side, so what is near stands in the cells around. Points meet one row a cell: Spark
    broadcasts the cells where they are small, and else splits a cell that many points share."""
    box = edges_of(areas).agg(F.min("ax"), F.max("ax"), F.min("ay"), F.max("ay")).first()
    rows = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if box[0] is None:
        return rows.select(F.col("key").alias(key), F.lit(None).cast("string").alias("area"), F.lit("unplaced").alias("method"))
    g = max(near, max(box[1] - box[0], box[3] - box[2]) / ACROSS) or 1.0
    edges = edges_of(areas)
    in_box = F.col("x").between(box[0] - 2 * g, box[1] + 2 * g) & F.col("y").between(box[2] - 2 * g, box[3] + 2 * g)
    placed = rows.withColumns({"cx": F.when(in_box, F.floor(F.col("x") / g)), "cy": F.when(in_box, F.floor(F.col("y") / g))})
    met = placed.join(covered(edges, g), ["cx", "cy"], "left")
    mx, my = (F.col("cx") + 0.5) * g, (F.col("cy") + 0.5) * g
    count = lambda a: F.aggregate(a["edges"], F.lit(0), lambda n, e: n + crosses(e, mx, my, F.col("x"), F.col("y")))
    tol = DOUBT * max(g, *map(abs, box))
    unsure = lambda a: F.exists(a["edges"], lambda e: doubtful(e, mx, my, F.col("x"), F.col("y"), tol))
    holds = F.filter("areas", lambda a: ((count(a) % 2 == 1) != a["odd"]) & ~unsure(a))
    asked = met.select("x", "y", "cy", F.explode(F.filter("areas", unsure)["area"]).alias("area"))
    exact = Scratch(points.sparkSession, "areas").write("exact", counted(asked, edges, g))  # few points lie on edges
    found = met.select("key", "x", "y", "cx", "cy", F.get(holds, 0)["area"].alias("sure")).join(exact, ["x", "y"], "left").select("key", "x", "y", "cx", "cy", F.least("sure", "exact").alias("inside"))
    step = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    around = touched(edges, g).withColumn("cx", F.explode(F.transform(step, lambda i: F.col("cx") + i))).withColumn("cy", F.explode(F.transform(step, lambda i: F.col("cy") + i)))
    around = around.distinct().groupBy("cx", "cy").agg(F.collect_list(F.struct("area", "ax", "ay", "bx", "by")).alias("edges"))
    # a point that is inside asks no neighbours
    lost = found.withColumns({"cx": F.when(F.col("inside").isNull(), F.col("cx")), "cy": F.when(F.col("inside").isNull(), F.col("cy"))}).join(around, ["cx", "cy"], "left")

    def gap(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - e["ax"]) * dx + (F.col("y") - e["ay"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))))
        right, up = F.col("x") - e["ax"] - part * dx, F.col("y") - e["ay"] - part * dy
        return F.sqrt(right * right + up * up)

    best = F.array_min(F.transform("edges", lambda e: F.struct(gap(e).alias("d"), e["area"].alias("area"))))
    lost = lost.withColumn("best", best)
    area = F.coalesce("inside", F.when(F.col("best.d") <= near, F.col("best.area")))
    method = F.when(F.col("inside").isNotNull(), "inside").when(area.isNotNull(), "nearest").otherwise("unplaced")
    return lost.select(F.col("key").alias(key), area.alias("area"), method.alias("method"))
