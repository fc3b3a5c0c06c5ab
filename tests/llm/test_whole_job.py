"""Whole jobs: what a bounded sample, a size switch or a cap would leave out."""

import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from corpusstat.llm import blocks, lm, minhash, queries, secret_scan, substring, url_filter
from corpusstat.llm.blocks import Scratch

P = queries.public_tokenizers


def scores(spark, rows):
    return {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), P.path(queries.RANKS), P.PATTERN).collect()}


def test_lm_rare_words_count_the_same_joined_or_broadcast(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("river stone cloud meadow lantern harbour".split()) for _ in range(20)) + f" single{i}") for i in range(40)]
    want = scores(spark, rows)
    monkeypatch.setattr(lm, "FREQUENT", 8)
    got = scores(spark, rows)
    assert max(abs(want[i] - got[i]) for i in want) < 1e-3


def test_lm_learns_from_every_text_however_long_or_late(spark):
    r = random.Random(4)
    cycle = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(cycle * 500)
    assert len(long) > 20_000
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, f"{long} number {i}") for i in range(300)] + [(held[0], " ".join(cycle * 3))]
    shuffled = cycle * 3
    r.shuffle(shuffled)
    rows.append((held[1], " ".join(shuffled)))
    got = scores(spark, rows)
    assert got[held[0]] > got[held[1]] + 3


def test_secrets_every_run_and_short_or_digitless_ones(spark):
    r = random.Random(5)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda n, chars=alnum: "".join(r.choice(chars) for _ in range(n - 1)) + chars[-1]
    jwt, digitless = [pick(36), pick(60), pick(43)], pick(40, alnum[:52])
    rows = [(1, f"bearer token {'.'.join(jwt)} end"), (2, "password = Tr0ub4dor&3x!"), (3, f"api_key={digitless}"), (4, "postgres://admin:s3cr3tPa5sW0rd@dbhost/base"), (5, "the token economy and password management of ordinary settlements")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'src1' AS source")
    found = secret_scan.scan(df).collect()
    assert [x.value for x in sorted(found) if x.doc_id == 1] == jwt and len({(x.place, x.run) for x in found if x.doc_id == 1}) == 3
    red = {x.doc_id: x.text for x in secret_scan.redact(df).collect()}
    mask = secret_scan.MASK
    assert red == {1: f"bearer token {mask}.{mask}.{mask} end", 2: f"password = {mask}", 3: f"api_key={mask}", 4: f"postgres://admin:{mask}@dbhost/base", 5: rows[4][1]}


def test_near_dedup_pairs_at_exactly_the_threshold(spark):
    bags = spark.createDataFrame([(1, 1, list(range(28))), (2, 2, list(range(35)))], "node long, root long, es array<long>")
    assert [tuple(r) for r in minhash.rare_pairs(bags, 0.8, Scratch(spark, "test")).collect()] == [(2, 1)]


def test_url_model_on_other_addresses():
    weights, intercept = url_filter.fit(tuple(url_filter.labelled()))
    held = url_filter.labelled(99)
    right = sum((intercept + sum(weights[g] for g in url_filter.grams(f"^{host}^{path}$")) >= 0) == bool(y) for host, path, y in held)
    assert len(held) <= url_filter.MAX_LABELLED and right / len(held) >= 0.97


def test_url_urls_of_all_kinds(spark):
    long = "http://news.example.com/" + "a/" * 50_000
    rows = [(1, long, "h", 0), (1, long, "h", 0), (2, "http://ÄÖ.example.com/日本", "h", 1), (3, "://", "h", 2), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = sorted(map(tuple, url_filter.judge(df).select("page_id", "host", "rule").collect()), key=repr)
    assert got == sorted([(1, "news.example.com", None), (1, "news.example.com", None), (2, "ÄÖ.example.com", None), (3, "", None), (None, "", None)], key=repr)


def test_url_verdict_of_a_very_long_url(spark):
    """The model reads it whole, and in seconds."""
    weights, intercept = url_filter.fit(tuple(url_filter.labelled()))
    rows = [("http://news.example.com/" + "music/" * 17_000,), ("http://bets.example.com/" + "casino-slots/" * 8_000,), ("http://x.example.com/" + "日本😀/" * 25_000,)]
    begun = time.time()
    got = {r.path: r for r in url_filter.judge(spark.createDataFrame(rows, "url string").selectExpr("1L as page_id", "url")).collect()}
    assert time.time() - begun < 60 and len(got) == 3
    for path, r in got.items():
        assert len(path) >= 99_000 and r.rule is None
        assert r.log_odds == intercept + sum(weights[g] for g in url_filter.grams(f"^{r.host}^{path}$")) and r.verdict == ("block" if r.log_odds >= 0 else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_chat_and_secrets_of_all_kinds(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    only = queries.op7_chat_format(spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in only] == [(-7, 2, 21)]
    long = "plain words and more " * 20_000 + "token = 9f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fd"
    df = spark.createDataFrame([(1, long, "s", 3), (1, long, "s", 3), (None, None, None, None)], "doc_id long, text string, source string, place int")
    assert [(r.doc_id, r.secret) for r in secret_scan.scan(df).collect()] == [(1, True), (1, True)]
    red = secret_scan.redact(df)
    assert red.columns == df.columns and [len(r.text) for r in red.where("doc_id = 1").collect()] == [len(long) - 40 + len(secret_scan.MASK)] * 2


def test_pipeline_on_rows_of_all_kinds(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))
    one, two, item = prose(120), prose(200), prose(12)
    token = "9f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fd"
    texts = [(1, one), (1, one), (2, one + " more"), (None, one), (3, None), (4, ""), (5, "too short"), (6, two + f" token = {token} " + item), (None, prose(90)), (7, item * 1 + " " + prose(5))]
    rows = [(i, t, "en", "src1", 1, "x", "y") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, _text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), before.schema)
    left = {x.doc_id: x.text for x in docs.where("doc_id is not null").collect()}
    assert set(left) == {1, 6} and left[1] == one and left[6].strip() == two + " token = [SECRET]"
    assert docs.where("doc_id is null").count() == 1
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(ids) == 3 and all(len(x.ids) == x.n_tokens > 0 for x in ids)


def test_lm_beats_the_base_on_held_out_texts(spark):
    out = queries.op2_lm_score(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert out.s > out.b + 0.1


def test_repeated_passages_meet_in_any_number_of_partitions(spark):
    """Shards and the passages streamed through them, in partitions that aren't put together afterwards."""
    r = random.Random(8)
    same = [[f"s{k}w{r.randrange(500)}" for _ in range(60)] for k in range(30)]
    own = lambda i: [f"d{i}w{r.randrange(500)}" for _ in range(70)]
    rows = [(i, " ".join(own(i) + same[i % 30] + own(i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {x.doc_id: x.n_removed for x in substring.deduplicate(df, shard_words=300).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 60 * (i >= 30) for i in range(60)}


def test_lm_trains_on_where_all_entries_have_moved_far_down_or_up():
    """A task that trains for long moves all entries of a softmax alike, which changes no probability and must not end in sums of 0 or infinity."""
    rng = np.random.default_rng(9)
    m, codes, n = lm.initial(rng.integers(0, 50, 6000)), rng.integers(0, 6000, 3000), np.array([1000, 1990, 10])
    want = lm.Trainer(m, 0)(codes, n)
    for by in (-150, 150):
        moved = lm.Trainer(m | {k: m[k] + np.float32(by) for k in ("c", "m")}, 0)
        assert np.allclose(moved(codes, n), want, atol=1e-2) and all(np.isfinite(moved.m[k]).all() for k in lm.LEARNT)
    long = lm.Trainer(m, 0)
    for _ in range(3):
        long(codes, n)
    assert abs(long.m["c"].mean()) < 1e-4 and np.abs(long.m["m"].mean(axis=1)).max() < 1e-4
    steep = m | {"m": m["m"] * np.float32(60)}  # entries over 80 are told apart as well
    z = steep["m"].astype(float)
    _, member = divmod(steep["target"][codes], lm.MEMBERS)
    cls = steep["target"][codes] // lm.MEMBERS
    own, _ = lm.picked(steep["m"][cls].copy(), member)
    peak = z.max(axis=1, keepdims=True)
    assert np.allclose(own, (z - peak - np.log(np.exp(z - peak).sum(axis=1, keepdims=True)))[cls, member], atol=1e-2)


def test_lm_steps_grow_with_what_a_task_has_to_train_on():
    """Long training takes few large steps (one for each 64 windows took most of the time), short training as many small ones, and both learn."""
    cycle = np.tile(np.arange(12), 20_000)
    m = lm.initial(np.bincount(cycle, minlength=6000))
    t = lm.Trainer(m, 0)
    before = lm.code_scores(m, cycle[:4800], np.array([4800])).mean()
    lp = t(cycle, np.array([len(cycle)]))
    windows = -(-len(cycle) // lm.SCORED)
    assert 20 < t.step < windows / 64 and lp[-4800:].mean() > before + 1
    assert np.allclose(t.flat, np.concatenate([t.m[k].ravel() for k in lm.LEARNT]))
    short = lm.Trainer(m, 0)
    short(cycle[:7200], np.array([7200]))
    assert short.step >= 4


def test_lm_gradients_against_differences():
    """The gradient of each part of the model, along a random direction, against the change of the sum of log probabilities."""
    rng = np.random.default_rng(12)
    m = lm.initial(rng.integers(0, 50, 6000))
    m = m | {k: (m[k] + 0.2 * rng.standard_normal(m[k].shape)).astype(float) for k in lm.LEARNT} | {"mask": m["mask"].astype(float)}
    n = np.array([3, 0, lm.SCORED, 60 * lm.SCORED + 5, 1])
    inputs, goals, good = lm.batches(m, rng.integers(0, 6000, int(n.sum())), n)
    g = {k: np.zeros(m[k].shape) for k in lm.LEARNT}
    lp = lm.gradients(m, lm.ready(m), inputs, goals, good, g)
    assert np.allclose(lp, lm.code_scores(m | {"rest": np.zeros(6000)}, *_sequences(m, goals, n)), atol=1e-5)
    for k in lm.LEARNT:
        way = rng.standard_normal(m[k].shape)
        up, down = (lm.gradients(moved, lm.ready(moved), inputs, goals, good, {j: np.zeros_like(x) for j, x in g.items()}).sum() for moved in (m | {k: m[k] + by * way} for by in (1e-5, -1e-5)))
        assert np.isclose((down - up) / 2e-5, (g[k] * way).sum(), rtol=2e-3, atol=0.05), k


def _sequences(m, goals, n):
    """Codes with the targets of the windows, and the sequences' lengths."""
    code = np.zeros(lm.CLASSES * lm.MEMBERS, np.int64)
    code[m["target"]] = np.arange(len(m["target"]))
    return code[goals[goals >= 0]], n


def test_lm_works_on_arrays_that_fit_a_cache():
    """Scoring and training took half as long again while the softmax of a whole step stood in one array, and products were copied for their size."""
    rng = np.random.default_rng(13)
    m, codes, n = lm.initial(rng.integers(0, 50, 6000)), rng.integers(0, 6000, 384 * lm.SCORED), np.array([384 * lm.SCORED])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        lm.code_scores(m, codes, n)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    print(peak)
    assert peak < 4 * len(codes) * lm.CLASSES * 1.5  # the first softmax's entries alone would take two thirds of it
    assert lm.PLACES * lm.MEMBERS * (lm.WIDTH + 1) < 10**6


def test_word_hashes_of_short_and_long_words():
    """By plain Python: sums of a value for each byte and place, whether words are short, long, mixed, or in another order."""
    r = random.Random(14)
    sizes = [1, 2, 63, 64, 65, 66, 127, 128, 300, 1000, *(r.randrange(1, 90) for _ in range(200))]
    text = [bytes(r.randrange(97, 123) for _ in range(k)) for k in sizes]
    data = np.frombuffer(b" ".join(text), np.uint8)
    ends = np.cumsum(np.array(sizes) + 1) - 1
    starts = ends - sizes
    whole = 1 << 64

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        return x ^ x >> 31

    want = np.array([mix((sum(mix(((p << 8) + b + blocks.BASE) % whole) for p, b in enumerate(w)) + len(w)) % whole) for w in text], np.uint64)
    for some in (range(len(text)), range(10), range(2), [5], r.sample(range(len(text)), len(text))):
        assert (blocks.word_hashes(data, starts[list(some)], ends[list(some)]) == want[list(some)]).all()


def test_words_are_looked_up_by_the_beginnings_of_their_hashes():
    """As a search in all sorted keys finds them, with keys that begin alike, the least and greatest, and none at all."""
    rng = np.random.default_rng(15)
    near = (np.uint64(7) << np.uint64(60)) + np.arange(50, dtype=np.uint64)
    for keys in (np.zeros(0, np.uint64), near, np.array([0, 2**64 - 1], np.uint64), np.unique(np.concatenate([near, rng.integers(0, 2**64, 5000, np.uint64)]))):
        words = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        want = [{k: i for i, k in enumerate(keys.tolist())}.get(w, len(keys)) for w in words.tolist()]
        assert lm.coded(words, keys, lm.begins(keys)).tolist() == want


def test_lm_words_without_a_target_of_their_own(spark, monkeypatch):
    """Looked up or joined, they get the same part of the shared target; one that training texts lack gets what a count of 0 gives. No subwords are needed."""
    r = random.Random(10)
    rows = [(i, " ".join(f"w{i * 40 + k}" if k % 2 else r.choice("river stone cloud".split()) for k in range(80))) for i in range(300)]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(held[0], "river unheard stone"), (held[1], "river w41 stone"), (held[2], "river w41 stone w41 unheard")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x.doc_id: x for x in lm.score(df).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 8)
    got = {x.doc_id: x for x in lm.score(df).collect()}
    assert len(want) == len(rows) and all(abs(want[i].score - x.score) < 1e-3 and abs(want[i].base_score - x.base_score) < 1e-9 and want[i][:5] == x[:5] for i, x in got.items())
    seen = [want[i] for i in held[:2]]
    assert [x.n_known for x in seen] == [3, 4]
    assert abs((seen[1].score - seen[0].score) - (seen[1].base_score - seen[0].base_score)) < 0.3


def test_repeated_passages_make_one_row_a_document():
    """Not one for each passage, of which a document of a large group has many."""
    word = [[f"p{k}w{i}" for i in range(8)] for k in range(5)]
    text = [" ".join(w) for w in word]
    reference = pa.table({"least": pa.array([1] * 5, pa.int64()), "words": text})
    streamed = [(o, 100 + o, 10 * k, text[k]) for k in range(5) for o in (1, 2, 3)] + [(4, 104, 0, "none of these words stands anywhere else"), (3, 99, 7, text[0])]
    streamed = pa.table({"ord": pa.array([x[0] for x in streamed], pa.int64()), "row": pa.array([x[1] for x in streamed], pa.int64()), "place": pa.array([x[2] for x in streamed], pa.int32()), "words": [x[3] for x in streamed]})
    found = substring.solved(reference, streamed, 6)
    whole = [10 * k + i for k in range(5) for i in range(3)]
    assert sorted((r["ord"], r["row"], sorted(r["places"])) for r in found.to_pylist()) == [(2, 102, whole), (3, 99, [7, 8, 9]), (3, 103, whole)]
    none = substring.solved(reference, streamed.slice(15, 1), 6)
    assert none.num_rows == 0 and none.schema == found.schema == substring.solved(reference.slice(0, 0), streamed, 6).schema
