"""Coherence, seeded clusters, board comparison, mutual information, validation and post-tag rules against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusstat.operators import mining, rules, sampling, scores, similar, stretches


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(5)
    centres = 3 * r.standard_normal((4, 6))
    return [(i, (5 + centres[i % 4] + r.standard_normal(6)).tolist(), [f"c{i % 4}", f"r{i * 7 % 3}", f"c{i % 4}"], f"s{i % 4}" if i % 4 < 2 and i < 40 else None) for i in range(400)]


def test_coherence_lift(spark, points):
    df = spark.createDataFrame(points, "id long, v array<double>, items array<string>, seed string")
    got = {r["item"]: r for r in similar.coherence_lift(df, "id", "v", F.col("items"), 10).collect()}
    m = np.array([p[1] for p in points])
    m = m - m.mean(0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for name in ("c0", "r1"):
        own = m[[i for i, p in enumerate(points) if name in p[2]]]
        assert got[name].n == len(own) and got[name].coherence == pytest.approx(np.linalg.norm(own.mean(0)))
    assert got["c0"].lift > 0.3 and abs(got["r1"].lift) < 0.1 and got["c0"].base == pytest.approx(got["c1"].base) and got["c0"].base < 0.25


def test_seeded_clusters(spark, points):
    df = spark.createDataFrame(points, "id long, v array<double>, items array<string>, seed string")
    members, report = similar.seeded_clusters(df, "id", "v", "seed")
    m = np.array([p[1] for p in points])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    names = ["s0", "s1"]
    own = {n: [i for i, p in enumerate(points) if p[3] == n] for n in names}
    c = np.array([m[own[n]].mean(0) for n in names])
    sims = m @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    got = {r.cluster: r for r in report.collect()}
    want = set()
    for j, n in enumerate(names):
        loo = []
        for i in own[n]:
            rest = m[own[n]].sum(0) - m[i]
            loo.append(m[i] @ rest / np.linalg.norm(rest))
        assert got[n].floor == pytest.approx(min(loo)) and got[n].background == pytest.approx(np.quantile(sims[:, j], 0.99), abs=0.01)
        want |= {(i, n) for i, p in enumerate(points) if p[3] == n or p[3] is None and sims[i].argmax() == j and sims[i, j] >= got[n].threshold}
    assert {(r.id, r.cluster) for r in members.collect()} == want


def test_board_comparison(spark):
    rows = [("a", i, 1.0 + i % 2, [f"x{i % 4}", f"x{i % 4}"]) for i in range(400)] + [("b", i, 1.0, ["y0"] if i % 2 else ["y0", "y1"]) for i in range(200)]
    got = {r.b: r for r in sampling.board_comparison(spark.createDataFrame(rows, "b string, id long, w double, l array<string>"), "b", "id", "w", F.col("l"), 60).collect()}
    whole = np.array([1.0, 2, 1, 2]) / 6
    assert got["a"].hhi == pytest.approx((whole**2).sum()) and got["a"].labels == 4 and got["a"].top10 == pytest.approx(1)
    assert got["a"].hhi_low < got["a"].hhi_sub < got["a"].hhi_high and abs(got["a"].hhi_sub - got["a"].hhi) < 0.02 and abs(got["b"].hhi_sub - (4 + 1) / 9) < 0.02


def ami(a, b):
    n, ca, cb, cab = len(a), Counter(a), Counter(b), Counter(zip(a, b))
    mi = sum(k / n * math.log(k * n / (ca[x] * cb[y])) for (x, y), k in cab.items())
    h = lambda c: -sum(k / n * math.log(k / n) for k in c.values())
    emi = sum(
        k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
        for x in ca.values() for y in cb.values() for k in range(max(1, x + y - n), min(x, y) + 1)
    )
    return (mi - emi) / ((h(ca) + h(cb)) / 2 - emi)


def test_mutual_information(spark):
    a, b = [i % 5 for i in range(120)], [i % 5 if i % 3 else i % 7 for i in range(120)]
    for x, y in ((a, b), (a, a), (b, [i * 7 % 11 for i in range(120)])):
        assert scores.adjusted_mutual_information(spark.createDataFrame(list(zip(x, y)), "a int, b int"), "a", "b").first().ami == pytest.approx(ami(x, y))


def test_skill_validation(spark):
    rows = [(i, ["x", f"y{i}"], ["x", f"y{i}", "z"]) for i in range(50)] + [(99, [], ["x"])]
    got = scores.skill_validation(spark.createDataFrame(rows, "id int, own array<string>, inferred array<string>"), "id", "own", "inferred").first()
    assert got.n == 50 and got.recall == 1 and got.precision == pytest.approx(2 / 3) and got.random_recall < 1


def test_post_rules(spark):
    rows = [
        (0, False, None, None, None, "", [], '{"channel": "sovereign cloud", "intensity": "low"', ""), (1, False, None, None, None, "", [], "junk", ""),
        (2, True, "diversification", "low", "supply-side", "parts", [], "", "just a job"), (3, True, "diversification", "low", "supply-side", "second source", [], "", ""),
        (4, True, "none", "none", "", "", ["SecNumCloud"], "", "Hello there. You will maintain our SecNumCloud platform."), (5, True, "none", "none", "", "", ["eucs"], "", "We like EUCS."),
        (6, True, "diversification", "low", "sovereign-tech", "aws, ovh, azure, gcp", ["ovh"], "", ""), (7, True, "diversification", "low", "sovereign-tech", "aws, ovh, azure, gcp", ["ovh", "gaia-x"], "", ""),
        (8, True, "diversification", "low", "", "x", [], "", "sovereign cloud"),
    ]
    tags = spark.createDataFrame(rows, "id int, ok boolean, channel string, intensity string, subtype string, evidence string, terms array<string>, raw string, text string")
    out = rules.ruled(tags, rules.post_rules("second source", "(?i)sovereign", ["ovh", "scaleway"]))
    got = {r.id: ((r.post_rule or "")[:2], r.channel, r.intensity, r.channel_model) for r in out.collect()}
    assert got == {
        0: ("R0", "diversification", "low", None), 1: ("", None, None, None), 2: ("R1", "none", "none", "diversification"), 3: ("", "diversification", "low", None),
        4: ("R2", "diversification", "high", "none"), 5: ("R2", "diversification", "low", "none"), 6: ("R3", "none", "none", "diversification"), 7: ("", "diversification", "low", None), 8: ("", "diversification", "low", None),
    }


def test_placebo_and_language(spark):
    quiet = spark.createDataFrame([("u", a, r) for a, r in [(0, 1.0), (3, 1.05), (8, 1.5), (10, 0.95), (30, 1.0)]], "unit string, at int, ratio double")
    jumped = spark.createDataFrame([("u", 20)], "unit string, at int")
    assert {(r.at, r.ratio) for r in stretches.placebos(quiet, jumped, ["unit"], "at", "ratio", 1.1, 5).collect()} == {(0, 1.0), (10, 0.95), (30, 1.0)}
    words = {"en": ["the", "of", "and"], "sv": ["och", "för", "the"]}
    rows = [(1, "The of OF and, and of"), (2, "för att och för, och OCH för"), (3, "of och"), (4, None), (5, "the the the the the the")]
    got = {r.id: (r.language, r.hits) for r in mining.language(spark.createDataFrame(rows, "id int, t string"), "id", F.coalesce("t", F.lit("")), words).collect()}
    assert got == {1: ("en", 5), 2: ("sv", 6), 3: ("unclear", 1), 4: ("unclear", 0), 5: ("unclear", 0)}


def test_svd_vectors(spark):
    from corpusstat.operators import reduce

    r = np.random.default_rng(2)
    m = (r.random((60, 3)) * [9, 4, 2]) @ r.random((3, 40)) + 0.01 * r.random((60, 40))
    m[r.random(m.shape) < 0.1] = 0
    rows = [(i, f"t{j:02d}", float(m[i, j])) for i in range(60) for j in range(40) if m[i, j]]
    df = spark.createDataFrame(rows, "id int, term string, w double")
    got = {x.id: np.array(x.vector) for x in reduce.svd_vectors(df, "id", "term", "w", 5, turns=12, block_weight=2.0).collect()}
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = u[:, :5] * s[:5]
    want = 2 * want / np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.array([got[i] for i in range(60)])
    assert mine.shape == (60, 5) and np.abs(mine @ mine.T - want @ want.T).max() < 0.02
    assert reduce.svd_vectors(df.limit(0), "id", "term", "w", 5).count() == 0


def test_candidate_sheet_makes_its_terms_once(spark, monkeypatch):
    made, write = [], similar.Scratch.write
    monkeypatch.setattr(similar.Scratch, "write", lambda self, name, t: made.append(name) or write(self, name, t))
    scored = spark.createDataFrame([("a", 10, 3.0), ("a b", 9, 2.0), ("b", 20, 1.0), ("a b c", 2, 4.0), ("d", 5, -1.0)], "term string, a long, z double")
    found = spark.createDataFrame([(x, t) for x in ("a", "a b", "b", "a b c", "d") for t in ("One", "two ")], "term string, title string")
    got = [r.term for r in similar.candidate_sheet(scored, found, F.lit(False), 2, 0.8, 10).collect()]
    assert got == ["a b c", "a b", "b"] and made == ["rows"]
