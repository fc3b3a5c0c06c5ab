"""Fill-in-middle, the Merkle manifest and mixing against brute force, with nulls, empties, ties, repeats, very long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusstat.llm import infill, merkle, mixing, queries
from corpusstat.llm.blocks import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id long, i int, n int, grp string, kept string, size int, form string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcXYZ é😀<PSM>\n") for _ in range(r.randint(1, 7)))
    out = [(i, r.choice(["a", "b", "c", None]), r.choice(["de", "en", "é", "", None]), r.choice([None, i]), " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(150)]
    out += [(500, "a", "one", 1, "Alone"), (501, None, None, None, None), (None, "a", "de", 3, "No id"), (None, "a", "de", 3, "No id"), (7, "a", "de", 5, "tie"), (7, "a", "de", 5, "TIE"), (7, "a", "de", 5, "TIE")]
    out += [(502, "b", "en", 0, ""), (503, "b", "en", 9, "has <S> inside"), (504, "long", "en", 9, "word, " * 60_000), (505, "long", "en", 1, "x" * 300_000), (506, "<P", "en", 9, "<P <S <M> < <<P")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, "g", "k", 4, "f") for r in rows()], SCHEMA)


def test_fill_in_middle(docs):
    got = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    want, forms = [], set()
    for i, _, _, _, text in rows():
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        forms.add(form)
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((i, len(units), form, *((p, m, s) if form != "plain" else (None,) * 3), out, text))
    assert forms == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def digest_tree(leaves, fanout):
    """Root and, for each leaf, its path, by plain lists."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        level = [sha("".join(level[j : j + fanout])) for j in range(0, len(level), fanout)]
    return level[0], paths


def plain_leaf(row, lower=False):
    out = ""
    for k, v in enumerate(row):
        v = None if v is None else str(v)
        if lower and k == 4 and v is not None:
            v = re.sub("[A-Z]", lambda m: m[0].lower(), v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


@pytest.mark.parametrize("fanout", [8, 2])
def test_merkle(docs, fanout):
    got = merkle.manifest(docs, fanout=fanout).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    groups = {}
    for r in rows():
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), plain_leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: digest_tree([d for _, d, _ in sorted(groups[g])], fanout) for g in names}
    root, above = digest_tree([trees[g][0] for g in names], fanout)
    want = [(i, g, place, d, trees[g][0], root, trees[g][1][place] + above[k]) for k, g in enumerate(names) for place, (_, d, i) in enumerate(sorted(groups[g]))]
    assert sorted(((*r[:6], [tuple(s) for s in r.path]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.folded == root for r in got)


def test_merkle_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_merkle_manifest(spark, SF).collect():
        d = docs[r.doc_id]
        same = zlib.crc32(str(r.doc_id).encode()) % 3 or not re.search("[A-Z]", d.text or "")
        assert r.leaf == plain_leaf((d.doc_id, d.source, d.lang, d.n_chars, d.text)) and r.verified == bool(same)


def test_merkle_of_few_and_of_equal_rows(spark, docs):
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("doc_id = 500")).collect()
    assert [(r.leaf, r.path) for r in one] == [(one[0].root, [])] and one[0].root == one[0].subroot
    many = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), *(F.lit("x").alias(c) for c in merkle.FIELDS[1:]))
    got = merkle.manifest(many).collect()
    root, paths = digest_tree([got[0].leaf] * 1000, 8)
    assert {r.root for r in got} == {root} and sorted(r.place for r in got) == list(range(1000))
    assert all([tuple(s) for s in r.path] == paths[r.place] for r in got)


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, full = budget * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        each = (whole - sum(most * sizes[s] for s in full)) / max(1e-12, sum(w[s] for s in open_))
        more = {s for s in open_ if w[s] * each >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else w[s] * each for s in names}
        full |= more


def plain_rates(sizes, target, most=2.0):
    """The rates of least relative entropy, by halving."""
    x = np.array(sizes, float)
    if target <= 0 or target >= most * x.sum():
        return np.where(x > 0, most if target > 0 else 0.0, 0.0)
    scale, low, high = x.sum() / (x > 0).sum(), -1e4, 1e4
    rate = lambda v: most * np.exp(-np.logaddexp(0, -v * x / scale)) * (x > 0)
    for _ in range(200):
        v = (low + high) / 2
        low, high = (v, high) if (rate(v) * x).sum() < target else (low, v)
    return rate(low)


def mixed_docs(spark, n=1500, seed=5):
    r = random.Random(seed)
    out = [(i, "hot" if i % 3 else r.choice(["a", "b", "c", None, "d"]), " ".join(["w"] * int(r.lognormvariate(4, 1)))) for i in range(n)]
    out += [(n, "empty", None), (n + 1, "empty", ""), (None, "a", "two words"), (None, "a", "two words"), (n + 2, "single", "w " * 500), (5, "c", "w " * 40), (5, "c", "w " * 40)]
    return out, spark.createDataFrame([(*x, 1, 2, 3) for x in out], "doc_id long, source string, text string, n int, v int, copies int")


def test_mixing(spark):
    plain, df = mixed_docs(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(plain)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in plain:
        sizes.setdefault(s, []).append(size(t))
    want = plain_targets({s: sum(v) for s, v in sizes.items()})
    for s, v in sizes.items():
        rows = [r for r in got if r.source == s]
        assert sorted(r.size for r in rows) == sorted(v) and all(r.target == pytest.approx(want[s]) and r.source_size == sum(v) for r in rows)
        of = dict(zip(v, plain_rates(v, want[s])))
        assert all(r.rate == pytest.approx(of[r.size], abs=1e-5) and 0 <= r.copies <= 2 for r in rows)
        assert abs(sum(r.copies * r.size for r in rows) - want[s]) <= (1 if s != "single" else 250)
    for key in {(r.source, r.size) for r in got}:
        copies = [r.copies for r in got if (r.source, r.size) == key]
        assert max(copies) - min(copies) <= 1
    again = mixing.mix(df.repartition(13).orderBy(F.rand(3))).collect()
    assert sorted(again, key=repr) == sorted(got, key=repr)
    assert mixing.expand(mixing.mix(df)).count() == sum(r.copies for r in got)


def test_mixing_ends(spark):
    _, df = mixed_docs(spark, 60)
    assert mixing.mix(df.limit(0)).collect() == []
    assert {(r.size, r.target, r.copies) for r in mixing.mix(df.withColumn("text", F.lit(" "))).collect()} == {(0, 0.0, 0)}
    one = mixing.mix(df.where("source = 'hot'")).collect()
    assert one[0].target == 1.5 * one[0].source_size and abs(sum(r.copies * r.size for r in one) - one[0].target) < min(r.size for r in one if r.size)
    none = mixing.mix(df.where("source in ('hot', 'a')"), weights=(1, 0)).collect()  # 'a' weighs 1, 'hot' nothing
    assert {r.copies for r in none if r.source == "hot"} == {0} and {r.copies for r in none if r.source == "a"} == {2}


@pytest.mark.parametrize("part", [1e-6, 0.01, 0.5, 1.0, 1.999, 1.9999999])
def test_duals_meet_any_target(spark, part):
    r = np.random.default_rng(2)
    sizes = np.unique(r.pareto(0.7, 400).astype(int) + 1)[:200]
    n = r.integers(1, 50, len(sizes))
    whole = int((sizes * n).sum())
    bins = spark.createDataFrame([("s", int(a), int(b)) for a, b in zip(sizes, n)], "source string, size long, n long")
    aims = spark.createDataFrame([("s", whole, int(n.sum()), part * whole)], "source string, source_size long, sized long, target double")
    d = mixing.balance(Scratch(spark, "test"), bins, aims).first()
    rate = 2 * np.exp(-np.logaddexp(0, -d.v * sizes / d.mean))
    assert (rate * n * sizes).sum() == pytest.approx(part * whole, rel=1e-8, abs=1e-3) and not math.isnan(d.v)


def test_attention_against_loops():
    """Log probabilities of codes by plain loops over the places that each one sees."""
    from corpusstat.llm import lm

    rng = np.random.default_rng(5)
    m = lm.initial(rng.integers(0, 50, 6000))
    m = m | {k: m[k] + (0.3 * rng.standard_normal(m[k].shape)).astype(np.float32) for k in lm.LEARNT}
    n = np.array([3, 0, lm.SCORED, 2 * lm.SCORED + 5, 1])
    codes = rng.integers(0, 6000, int(n.sum()))
    got = lm.code_scores(m, codes, n, windows_at_once=2, inner=1)
    want, at = [], 0
    soft = lambda z: z - np.log(np.exp(z).sum())
    for size in n.tolist():
        own = m["target"][codes[at : at + size]]
        before = [lm.CLASSES * lm.MEMBERS, *own[:-1].tolist()]
        for j in range(size):
            begin = j // lm.SCORED * lm.SCORED - (lm.WINDOW - lm.SCORED)
            seen = [i for i in range(max(0, begin), j + 1)]
            x = np.array([m["E"][before[i]] + m["P"][i - begin] for i in seen], float)
            q = x[-1] @ m["Q"]
            weight = np.exp(np.minimum([q @ (row @ m["K"]) for row in x], 60))
            h = x[-1] + (weight / weight.sum()) @ (x @ m["V"]) @ m["O"]
            cls, member = divmod(int(own[j]), lm.MEMBERS)
            want.append(soft(h @ m["C"] + m["c"])[cls] + soft(h @ m["M"][cls] + m["m"][cls])[member] + m["rest"][codes[at + j]])
        at += size
    assert np.allclose(got, want, atol=2e-3)


def test_slices_average_in_two_steps(spark):
    """As many tasks as there are rows of a slice, weighted by what each saw."""
    from corpusstat.llm import lm

    m = lm.initial(np.arange(6000))
    rng = np.random.default_rng(6)
    trainers, rows = [], []
    for i in range(23):
        t = lm.Trainer(m, 0)
        t.m = {k: (v + rng.standard_normal(v.shape)).astype(np.float32) if k in lm.LEARNT else v for k, v in t.m.items()}
        t.seen = int(rng.integers(1, 9))
        trainers.append(t)
        rows += t.slices().to_pylist() + [{"slice": -1, "weight": 0.0, "w": np.full(lm.BINS, float(i)).tobytes()}]
    df = spark.createDataFrame([(r["slice"], r["weight"], bytearray(r["w"])) for r in rows], "slice int, weight double, w binary").repartition(7)
    out, ratios = lm.averaged(m, df)
    whole = sum(t.seen for t in trainers)
    for k in lm.LEARNT:
        assert np.allclose(out[k], sum(t.m[k].astype(float) * t.seen for t in trainers) / whole, atol=1e-5)
    assert (ratios == sum(range(23))).all()
    same, none = lm.averaged(m, df.limit(0))
    assert same is m and not none.any()


def test_lm_beats_the_base_on_small_data(spark):
    out = queries.op2_lm_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b", "sum(n_tokens) n").first()
    print(out)
    assert out.s > out.b + 0.02
