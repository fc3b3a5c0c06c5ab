"""Composition stability: distances of category counts cut to one size, and their null from shuffles of whole days.

Rows are summed to counts by day and category first. A comparison's counts are split into blocks of at most BLOCK categories, so a task holds a matrix of days
by BLOCK categories, however many categories there are. What doesn't depend on rows is drawn from seeds, the same in every task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.tables import Scratch

#: Categories of a block, shuffles of a block of shuffles, draws of the observed distance, and what is added to each count.
BLOCK, SHUFFLES, REPEATS, TINY = 1024, 100, 5, 1e-12
#: numpy's sampler of the hypergeometric distribution ends here; larger ones are drawn by large_draw().
SAMPLER = 10**9


def generator(seed: int, *names) -> np.random.Generator:
    """A stream for the names, the same wherever it is made."""
    return np.random.default_rng([seed, *(zlib.crc32(str(n).encode()) for n in names)])


def large_draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """A hypergeometric draw of any size, by the inverse of the distribution within 40 standard deviations of its mode."""
    low, high = max(0, taken - bad), min(good, taken)
    mode = min(max((taken + 1) * (good + 1) // (good + bad + 2), low), high)
    share = good / (good + bad)
    spread = 40 * int(np.ceil(np.sqrt(taken * share * (1 - share) + 1)))
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1)
    a, b = k[:-1].astype(float), k[1:].astype(float)
    steps = np.log(good - a) + np.log(taken - a) - np.log(b) - np.log(bad - taken + b)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(upto, rng.random() * upto[-1]), len(k) - 1)])


def cut(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A random sample of n of sum(counts) things without replacement, as counts (all of them if there are no more than n): multivariate
    hypergeometric, by draws for one category after the other."""
    counts = np.asarray(counts, np.int64)
    left, whole = int(n), int(counts.sum())
    if whole <= left:
        return counts.copy()
    if whole < SAMPLER:
        return rng.multivariate_hypergeometric(counts, left)
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        whole -= c
        if c and left:
            out[i] = left if not whole else rng.hypergeometric(c, whole, left) if c + whole < SAMPLER else large_draw(rng, c, whole, left)
            left -= int(out[i])
    return out


def distance(a: np.ndarray, b: np.ndarray, total_a: float, total_b: float) -> float:
    """Part of the Jensen-Shannon distance (base 2) that categories with these shares' numerators add."""
    p, q = (a + TINY) / total_a, (b + TINY) / total_b
    m = (p + q) / 2
    return float((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)


def shuffled(sides: np.ndarray, strata: list, rng: np.random.Generator) -> np.ndarray:
    """Which days are on the first side after a shuffle within strata, each stratum's sides keeping their numbers of days."""
    out = np.zeros(len(sides), bool)
    for s in sorted(set(strata), key=repr):
        at = np.array([i for i, x in enumerate(strata) if x == s])
        out[rng.permutation(at)[: int(sides[at].sum())]] = True
    return out


def compared(rows: DataFrame, unit: list[str], day: str, category: str, side: Column, stratum: Column | None = None, perm: int = 1000, seed: int = 1, least: int = 1, block: int = BLOCK) -> DataFrame:
    """E13 and E14, size-matched: per unit js, null, excess, p and n of the categories of the days where side holds and of those where it doesn't; days
    with a null side, and null categories' days alone, are left out (a null category is a category of its own).

    n is the smaller side's number of rows. Both sides are cut to n before every distance, observed and shuffled alike, since the distance of small samples is
    larger; js is the mean of REPEATS cuts, null the mean over `perm` shuffles of whole days between the sides (within `stratum`, where it is given), p =
    mean(null >= js) + 1/perm, which may exceed 1. Units with fewer than `least` rows on a side give no row. `side` and `stratum` are to be the same for all rows of a unit's day.

    Shuffles are a matrix of shuffles by days, times one of days by categories, in blocks of both: no row is repeated for a shuffle. Days are a
    calendar's, so a unit's list of them is held in a task; a block's share of a cut is drawn first, then the cut within the block."""
    tables = Scratch(rows.sparkSession, "composition")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in unit]
    cells = rows.select(F.to_json(F.array(*keys)).alias("_unit"), *unit, F.col(day).cast("string").alias("_day"), F.coalesce(F.col(category).cast("string"), F.lit("\0")).alias("_cat"), side.cast("boolean").alias("_side"), (stratum if stratum is not None else F.lit("")).cast("string").alias("_stratum"))
    cells = cells.where("_side is not null and _day is not null").groupBy("_unit", *unit, "_day", "_side", "_stratum", "_cat").agg(F.count("*").alias("_n"))
    cells = tables.write("cells", cells)
    sizes = cells.groupBy("_unit", *unit).agg(F.sum(F.when(F.col("_side"), F.col("_n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("_side"), 0).otherwise(F.col("_n"))).alias("_b"))
    categories = cells.select("_unit", "_cat").distinct().groupBy("_unit").agg(F.count("*").alias("_cats"))
    sizes = sizes.where(F.least("_a", "_b") >= least).join(categories, "_unit").withColumn("_blocks", F.ceil(F.col("_cats") / block).cast("int"))
    sizes = tables.write("sizes", sizes)
    # A unit's days, each with its side and stratum: as long as the calendar.
    days = cells.select("_unit", "_day", "_side", "_stratum").distinct().groupBy("_unit").agg(F.sort_array(F.collect_list(F.struct("_day", "_side", "_stratum"))).alias("_days"))
    about = sizes.select("_unit", "_blocks", F.least("_a", "_b").alias("_size"), "_cats").join(days, "_unit")
    rounds = -(-perm // SHUFFLES)
    matrix = cells.select("_unit", "_day", "_cat", "_n").join(sizes.select("_unit", "_blocks"), "_unit").withColumn("_block", F.pmod(F.xxhash64("_cat"), F.col("_blocks")).cast("int"))
    matrix = matrix.select("_unit", "_block", "_day", "_cat", "_n", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("_round"))
    tasks = about.select("_unit", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_days").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of shuffles times a block of categories: the first side's counts and all counts of the comparison. Round 0 is the observed split."""
        empty = pa.table({"_unit": pa.array([], pa.string()), "_block": pa.array([], pa.int32()), "_draw": pa.array([], pa.int32()), "a": pa.array([], pa.list_(pa.int64())), "b": pa.array([], pa.list_(pa.int64()))})
        if not left.num_rows or not right.num_rows:
            return empty
        name, number, turn = (right.column(c)[0].as_py() for c in ("_unit", "_block", "_round"))
        listed = right.column("_days")[0].as_py()
        place = {d["_day"]: i for i, d in enumerate(listed)}
        sides, strata = np.array([d["_side"] for d in listed]), [d["_stratum"] for d in listed]
        cats, at = np.unique(np.array(left.column("_cat").to_pylist(), dtype=object), return_inverse=True)
        m = np.zeros((len(listed), len(cats)), np.int64)
        np.add.at(m, ([place[d] for d in left.column("_day").to_pylist()], at), left.column("_n").to_numpy())
        draws = [0] if turn == 0 else list(range((turn - 1) * SHUFFLES + 1, min(turn * SHUFFLES, perm) + 1))
        p = np.array([sides if d == 0 else shuffled(sides, strata, generator(seed, name, "days", d)) for d in draws], np.int64)
        first = p @ m
        other = m.sum(0)[None, :] - first
        lists = lambda x: pa.array(x.tolist(), pa.list_(pa.int64()))
        again = [d for d in draws for _ in range(REPEATS if d == 0 else 1)]
        index = [i for i, d in enumerate(draws) for _ in range(REPEATS if d == 0 else 1)]
        shown = [-r for r in range(REPEATS)] if turn == 0 else again  # 0, -1, ... are cuts of the observed split
        return pa.table({"_unit": [name] * len(index), "_block": pa.array([number] * len(index), pa.int32()), "_draw": pa.array(shown, pa.int32()), "a": lists(first[index]), "b": lists(other[index])})

    keyed = ["_unit", "_block", "_round"]
    sums = matrix.groupBy(*keyed).cogroup(tasks.groupBy(*keyed)).applyInArrow(product, "_unit string, _block int, _draw int, a array<long>, b array<long>")
    sums = tables.write("sums", sums)

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    held = sums.select("_unit", "_draw", "_block", total("a").alias("a"), total("b").alias("b")).join(sizes.select("_unit", F.least("_a", "_b").alias("_size")), "_unit")

    def shares(t: pa.Table) -> pa.Table:
        """What each block gets of a cut to size: one draw over the blocks' totals."""
        t = t.sort_by("_block")
        name, draw, size = (t.column(c)[0].as_py() for c in ("_unit", "_draw", "_size"))
        parts = {s: cut(t.column(s).to_numpy(), size, generator(seed, name, "blocks", draw, s)) for s in "ab"}
        return pa.table({"_unit": t.column("_unit"), "_draw": t.column("_draw"), "_block": t.column("_block"), "_ka": parts["a"], "_kb": parts["b"], "_ta": np.full(t.num_rows, parts["a"].sum()), "_tb": np.full(t.num_rows, parts["b"].sum())})

    parts = held.groupBy("_unit", "_draw").applyInArrow(shares, "_unit string, _draw int, _block int, _ka long, _kb long, _ta long, _tb long")
    joined = sums.join(parts, ["_unit", "_draw", "_block"]).join(sizes.select("_unit", "_cats"), "_unit")
    joined = joined.select("_unit", "_draw", "_block", "a", "b", "_ka", "_kb", "_ta", "_tb", "_cats")

    def partial(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for name, draw, number, a, b, ka, kb, ta, tb, cats in zip(*(rows[c] for c in ("_unit", "_draw", "_block", "a", "b", "_ka", "_kb", "_ta", "_tb", "_cats"))):
                x, y = (cut(v, k, generator(seed, name, "cut", draw, number, s)) for v, k, s in ((a, ka, "a"), (b, kb, "b")))
                out.append(distance(x, y, ta + cats * TINY, tb + cats * TINY))
            yield pa.RecordBatch.from_pydict({"_unit": rows["_unit"], "_draw": pa.array(rows["_draw"], pa.int32()), "d": pa.array(out, pa.float64())})

    each = joined.mapInArrow(partial, "_unit string, _draw int, d double").groupBy("_unit", "_draw").agg(F.round(F.sum("d"), 12).alias("d"))
    seen = each.where("_draw <= 0").groupBy("_unit").agg(F.avg("d").alias("js"))
    null = each.where("_draw > 0").join(seen, "_unit").groupBy("_unit", "js").agg(F.avg("d").alias("null"), (F.avg((F.col("d") >= F.col("js")).cast("int")) + 1 / perm).alias("p"))
    return sizes.join(null, "_unit").select(*unit, "js", "null", (F.col("js") - F.col("null")).alias("excess"), "p", F.least("_a", "_b").alias("n"))


def size_matched(rows: DataFrame, unit: list[str], category: str, side: Column, repeats: int = REPEATS, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """Per unit the Jensen-Shannon distance of the two sides' categories, both cut to the smaller one's n rows (mean of `repeats` cuts, counts
    smoothed by TINY), beside the plain one of all rows. Rows with a null side are left out; a null category is a category; a unit
    with an empty side gives no row. Counts are cut block by block of categories, as in compared()."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in unit]
    cells = rows.select(F.to_json(F.array(*keys)).alias("_unit"), *unit, F.coalesce(F.col(category).cast("string"), F.lit("\0")).alias("_cat"), side.cast("boolean").alias("_side")).where("_side is not null")
    count = lambda on: F.count_if(F.col("_side") if on else ~F.col("_side"))
    tables = Scratch(rows.sparkSession, "size-matched")
    cells = tables.write("cells", cells.groupBy("_unit", *unit, "_cat").agg(count(True).alias("a"), count(False).alias("b")))
    sizes = cells.groupBy("_unit", *unit).agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.count("*").alias("_cats")).where("_a > 0 and _b > 0")
    p, q = F.col("a") / F.col("_a"), F.col("b") / F.col("_b")
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    met = cells.join(sizes.drop(*unit), "_unit")
    plain = met.groupBy("_unit").agg((F.sum(term(p) + term(q)) / 2).alias("js_plain"))
    numbered = met.withColumn("_block", F.pmod(F.xxhash64("_cat"), F.ceil(F.col("_cats") / block)).cast("int"))
    totals = numbered.groupBy("_unit", "_block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.first(F.least("_a", "_b")).alias("_size"))

    def shares(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        name, size = t.column("_unit")[0].as_py(), t.column("_size")[0].as_py()
        out = {c: [] for c in ("_unit", "_block", "_rep", "_ka", "_kb")}
        for rep in range(repeats):
            k = {s: cut(t.column(s).to_numpy(), size, generator(seed, name, "blocks", rep, s)) for s in "ab"}
            for i, number in enumerate(t.column("_block").to_pylist()):
                for c, v in zip(out, (name, number, rep, int(k["a"][i]), int(k["b"][i]))):
                    out[c].append(v)
        return pa.table(out, schema=pa.schema([("_unit", pa.string()), ("_block", pa.int32()), ("_rep", pa.int32()), ("_ka", pa.int64()), ("_kb", pa.int64())]))

    parts = totals.groupBy("_unit").applyInArrow(shares, "_unit string, _block int, _rep int, _ka long, _kb long")

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        shape = pa.schema([("_unit", pa.string()), ("_rep", pa.int32()), ("d", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return pa.table({"_unit": [], "_rep": [], "d": []}, schema=shape)
        left = left.sort_by("_cat")
        name, number, cats, size = (left.column(c)[0].as_py() for c in ("_unit", "_block", "_cats", "_size"))
        out = []
        for rep, ka, kb in zip(*(right.column(c).to_pylist() for c in ("_rep", "_ka", "_kb"))):
            x, y = (cut(left.column(s).to_numpy(), k, generator(seed, name, "cut", rep, number, s)) for k, s in ((ka, "a"), (kb, "b")))
            out.append((name, rep, distance(x, y, size + cats * TINY, size + cats * TINY)))
        return pa.table(dict(zip(shape.names, map(list, zip(*out)))), schema=shape)

    held = numbered.select("_unit", "_block", "_cat", "a", "b", "_cats", F.least("_a", "_b").alias("_size"))
    each = held.groupBy("_unit", "_block").cogroup(parts.groupBy("_unit", "_block")).applyInArrow(partial, "_unit string, _rep int, d double")
    matched = each.groupBy("_unit", "_rep").agg(F.sum("d").alias("d")).groupBy("_unit").agg(F.avg("d").alias("js"))
    return sizes.join(plain, "_unit").join(matched, "_unit").select(*unit, "js", "js_plain", F.least("_a", "_b").alias("n"))
