"""Size-matched distances, shuffled days and stretches against plain numpy and lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusstat.operators import composition as K
from corpusstat.operators import stretches as T


@pytest.mark.parametrize("sampler", [10**9, 1])
def test_cut_has_the_mean_and_variance(monkeypatch, sampler):
    """By numpy's sampler, and by the one for larger numbers."""
    monkeypatch.setattr(K, "SAMPLER", sampler)
    counts, n, reps = np.array([50, 0, 400, 7, 143]), 120, 4000
    rng = np.random.default_rng(1)
    got = np.array([K.cut(counts, n, rng) for _ in range(reps)])
    share, whole = counts / counts.sum(), counts.sum()
    variance = n * share * (1 - share) * (whole - n) / (whole - 1)
    assert (got.sum(1) == n).all() and (got <= counts).all()
    assert np.abs(got.mean(0) - n * share).max() < 4 * np.sqrt(variance.max() / reps)
    assert np.allclose(got.var(0), variance, rtol=0.1)
    assert (K.cut(counts, 600, rng) == counts).all() and (K.cut(counts, 9999, rng) == counts).all()


def test_draws_of_more_than_the_sampler_holds():
    rng = np.random.default_rng(2)
    good, bad, taken = 3 * 10**10, 5 * 10**10, 10**9
    got = np.array([K.large_draw(rng, good, bad, taken) for _ in range(40)], float)
    share = good / (good + bad)
    spread = math.sqrt(taken * share * (1 - share) * (good + bad - taken) / (good + bad - 1))
    assert abs(got.mean() - taken * share) < 4 * spread / math.sqrt(40) and 0.6 < got.std() / spread < 1.5


def test_size_matched_ranks_where_the_plain_distance_does_not(spark):
    """Two small equal sides without a shift, and a small against a large side with one: only the cut to one size shows the latter."""
    r = np.random.default_rng(3)
    base = np.ones(60) / 60
    moved = base.copy()
    moved[:10] *= 2.5
    moved /= moved.sum()
    rows = [(unit, side, int(c)) for unit, side, n, p in (("same", True, 150, base), ("same", False, 150, base), ("moved", True, 150, moved), ("moved", False, 40_000, base)) for c in r.choice(60, n, p=p)]
    got = {g.u: g for g in K.size_matched(spark.createDataFrame(rows, "u string, side boolean, c int"), ["u"], "c", F.col("side"), repeats=40).collect()}
    assert got["same"].js_plain > got["moved"].js_plain and got["same"].js < got["moved"].js and {g.n for g in got.values()} == {150}
    assert got["same"].js == pytest.approx(got["same"].js_plain, abs=1e-6)


@pytest.mark.parametrize("block", [1024, 7])
def test_size_matched_in_blocks(spark, block):
    """Against cuts of the whole histogram in numpy: the mean of many."""
    r = random.Random(5)
    rows = [("u", r.random() < 0.2, min(int(r.expovariate(0.2)), 25) if r.random() < 0.95 else None) for _ in range(4000)] + [("one side", True, 1), ("v", None, 1)]
    df = spark.createDataFrame(rows, "u string, side boolean, c int")
    got = K.size_matched(df, ["u"], "c", F.col("side"), repeats=60, block=block).collect()
    cats = sorted({x[2] for x in rows if x[0] == "u"}, key=repr)
    a, b = (np.array([sum(x[1] is s and x[2] == c and x[0] == "u" for x in rows) for c in cats]) for s in (True, False))
    rng, n = np.random.default_rng(9), min(a.sum(), b.sum())

    def js(x, y):
        p, q = (x + 1e-12) / (x + 1e-12).sum(), (y + 1e-12) / (y + 1e-12).sum()
        m = (p + q) / 2
        return ((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2

    cut = lambda v: v if v.sum() <= n else rng.multivariate_hypergeometric(v, n)
    want = np.array([js(cut(a), cut(b)) for _ in range(400)])
    assert [(g.u, g.n) for g in got] == [("u", n)]
    assert abs(got[0].js - want.mean()) < 4 * want.std() / math.sqrt(60) + 1e-9 and got[0].js_plain == pytest.approx(js(a, b), abs=1e-6)


def brute(rows, unit, perm, seed, block_of, within):
    """compared() by loops over days, with the same streams."""
    rows = [r for r in rows if r[0] == unit and r[3] is not None and r[1] is not None]
    days = sorted({(r[1], r[3], r[4] if within else "") for r in rows})
    cats = sorted({r[2] for r in rows}, key=lambda c: "\0" if c is None else c)
    count = {}
    for r in rows:
        count[r[1], r[2]] = count.get((r[1], r[2]), 0) + 1
    blocks = sorted({block_of[c] for c in cats})
    name = f'["{unit}"]'

    def sums(on):
        first, other = ({c: sum(count.get((day[0], c), 0) for day, x in zip(days, on) if x == s) for c in cats} for s in (True, False))
        return first, other

    a0, b0 = sums([d[1] for d in days])
    n = min(sum(a0.values()), sum(b0.values()))

    def js(sides, draw):
        cut = {}
        for s, counts in zip("ab", sides):
            per = np.array([sum(counts[c] for c in cats if block_of[c] == k) for k in blocks])
            given = K.cut(per, n, K.generator(seed, name, "blocks", draw, s))
            cut[s] = {}
            for k, m in zip(blocks, given):
                mine = [c for c in cats if block_of[c] == k]
                cut[s].update(zip(mine, K.cut(np.array([counts[c] for c in mine]), m, K.generator(seed, name, "cut", draw, k, s))))
        p, q = (np.array([cut[s][c] for c in cats]) + 1e-12 for s in "ab")
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return ((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2

    seen = np.mean([js((a0, b0), -i) for i in range(5)])
    null = []
    for d in range(1, perm + 1):
        rng, on = K.generator(seed, name, "days", d), [False] * len(days)
        for s in sorted({x[2] for x in days}):
            at = [i for i, x in enumerate(days) if x[2] == s]
            for i in rng.permutation(at)[: sum(days[i][1] for i in at)]:
                on[i] = True
        null.append(js(sums(on), d))
    return seen, np.mean(null), np.mean(np.round(null, 12) >= np.round(seen, 12)) + 1 / perm, n


@pytest.mark.parametrize("block,within", [(1024, False), (4, True)])
def test_shuffled_days(spark, block, within):
    r = random.Random(8)
    rows = []
    for day in range(40):
        side, stratum = (None if day % 9 == 8 else day % 3 == 0), f"s{day % 2}"
        for unit in ("u", "v"):
            for _ in range(r.randint(1, 30)):
                c = r.choice("abcdefghij") if unit == "u" or day % 3 else r.choice("abc")
                rows.append((unit, f"2024-{day // 28 + 1:02d}-{day % 28 + 1:02d}", c if r.random() < 0.97 else None, side, stratum))
    rows.append(("single", "2024-01-01", "a", True, "s0"))
    df = spark.createDataFrame(rows, "unit string, day string, value string, side boolean, stratum string")
    got = {g.unit: g for g in K.compared(df, ["unit"], "day", "value", F.col("side"), F.col("stratum") if within else None, perm=200, block=block).collect()}
    assert set(got) == {"u", "v"}
    for unit in "uv":
        cats = {x[2] for x in rows if x[0] == unit and x[3] is not None}
        count = -(-len(cats) // block)
        block_of = {x.c: x.b for x in spark.createDataFrame([(c,) for c in cats], "c string").select("c", F.pmod(F.xxhash64(F.coalesce("c", F.lit("\0"))), F.lit(count)).alias("b")).collect()}
        js, null, p, n = brute(rows, unit, 200, 1, block_of, within)
        g = got[unit]
        assert (g.js, g.null, g.excess, g.p, g.n) == (pytest.approx(js, abs=1e-9), pytest.approx(null, abs=1e-9), pytest.approx(js - null, abs=1e-9), pytest.approx(p), n)
    assert got["v"].p < 0.01 + 1 / 200 < got["u"].p


def test_compared_without_rows(spark):
    df = spark.createDataFrame([], "unit string, day string, value string, side boolean")
    assert K.compared(df, ["unit"], "day", "value", F.col("side"), perm=3).collect() == [] == K.size_matched(df, ["unit"], "value", F.col("side")).collect()


def apart(candidates, span):
    taken = []
    for at, s in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if all(abs(at - x) >= span for x, _ in taken):
            taken.append((at, s))
    return set(taken)


def chain(places, gap):
    taken = []
    for at in sorted(places):
        if not taken or at - taken[-1] >= gap:
            taken.append(at)
    return set(taken)


def test_stretches_of_many_units(spark):
    r = random.Random(6)
    units = {u: [(at, r.choice([r.random(), 0.5])) for at in r.sample(range(-200, 400), r.choice([1, 5, 60, 200]))] for u in [None, *map(str, range(12))]}
    units["falling"] = [(at, 1000.0 - at) for at in range(30)]
    rows = [(u, at, s, 9) for u, v in units.items() for at, s in v] + [("0", None, 1.0, 9), ("1", 1000, None, 9)]
    df = spark.createDataFrame(rows, "unit string, at int, s double, _n int")
    for span in (1, 7, 50):
        got = T.strongest_apart(df, ["unit"], "at", F.col("s"), span).collect()
        assert {(g.unit, g.at, g.s) for g in got} == {(u, *x) for u, v in units.items() for x in apart(v, span)}
        got = T.chained(df.where("s is not null"), ["unit"], "at", span).collect()
        assert sorted((repr(g.unit), g.at) for g in got) == sorted((repr(u), x) for u, v in units.items() for x in chain([a for a, _ in v], span))
    assert T.strongest_apart(df.limit(0), ["unit"], "at", F.col("s"), 3).collect() == [] == T.chained(df.limit(0), ["unit"], "at", 3).collect()


def test_sources_of_many_boards(spark):
    """More than a hundred names, one of them twice."""
    from corpusstat.operators import titles

    rows = spark.range(500).select(F.concat(F.lit("s"), "id").alias("name"), F.col("id").alias("label_id"))
    boards = rows.where("label_id < 200").select(F.col("name").alias("source"), F.lit("b").alias("platform"), F.lit("FR").alias("country"))
    got = {r.name: r for r in titles.sources_known(rows, "name", rows.limit(0).select(F.col("name").alias("source"), F.lit("m").alias("label")), boards.union(boards)).collect()}
    assert len(got) == 500 and sum(r.platform == "b" and r.country == "FR" for r in got.values()) == 200 and got["s300"].platform == "s300" and got["s1"].label == "s1"
