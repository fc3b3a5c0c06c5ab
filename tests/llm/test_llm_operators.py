"""The operators against brute force and exact round trips, on small tables with nulls, empties, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusstat.llm import bpe, chat, decontaminate, lm, minhash, quality, queries, secret_scan, substring, url_filter, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß ü") for _ in range(r.randint(1, 6))).strip() or "x"
    base = [word() for _ in range(300)]
    out = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:150] + [word() for _ in range(60)])), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (None, " ".join(base[:80]))]
    near = list(base)
    near[100] = "changed"
    out += [(8, " ".join(near)), (9, "\n".join(["same line here again"] * 40)), (9, "\n".join(["same line here again"] * 40)), (10, "a " * 400), (11, "long" * 30_000)]
    return out + [(i, " ".join(word() for _ in range(r.randint(1, 200)))) for i in range(20, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2, 3, 4, "s") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, ord int, row int, node int, n_words int, source string")


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x)


@pytest.mark.parametrize("shard,stream", [(substring.SHARD, substring.STREAM), (300, 100), (1, 60)])
def test_substring(docs, monkeypatch, shard, stream):
    """With one shard, with several in several copies, and with passages cut up to their windows."""
    monkeypatch.setattr(substring, "STREAM", stream)
    got = sorted(map(tuple, substring.deduplicate(docs, shard_words=shard).collect()), key=repr)
    rows = [(math.inf if i is None else i, i, WORDS.findall(t or "")) for i, t in texts()]
    seen, want = {}, []
    for o, _, w in rows:
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            seen[k] = min(o, seen.get(k, o))
    for o, i, w in rows:
        hit = set()
        for p in range(len(w) - 49):
            if seen[tuple(w[p : p + 50])] < o:
                hit.update(range(p, p + 50))
        want.append((i, len(w), len(hit), " ".join(x for k, x in enumerate(w) if k not in hit)))
    assert got == sorted(want, key=repr)


def test_near_duplicates(docs):
    got = {r.doc_id: (r.class_id, r.text_id) for r in minhash.classes(docs).collect()}
    assert got[0] == got[1] == (0, 0) and got[8] == (0, 8) and got[6] == got[7] == (6, 6)
    assert got[2] == (2, 2) and got[4] == (4, 4) and got[5] == (5, 5) and got[3] == (3, 3)
    kept = [r.doc_id for r in minhash.keep_one(docs).collect()]
    assert kept.count(9) == 1 and 0 in kept and not {1, 7, 8} & set(kept)


def test_signatures_are_unbiased():
    import numpy as np

    r = np.random.default_rng(1)
    gram = r.integers(1, 2**63, 60).astype(np.uint64)
    a, b = r.integers(1, 9, 60), r.integers(1, 9, 60)
    s = minhash.signatures(np.repeat([0, 1], 60), np.concatenate([gram, gram]), np.concatenate([a, b]), 2, m=4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_quality(docs):
    got = sorted(tuple(r)[:7] for r in quality.judge(docs.where("doc_id is not null")).collect())
    want = []
    for i, t in texts():
        if i is None:
            continue
        w = WORDS.findall(t or "")
        c = collections.Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        hit = {q for p in range(len(w) - 4) if c[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert got == sorted(want)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {20 + i for i in range(20) if len(WORDS.findall(dict(texts())[20 + i])) > 30}


@pytest.mark.parametrize("most, at_once", [(200_000, 8), (15, 8), (15, 1)])
def test_decontamination(spark, docs, most, at_once):
    base = texts()[0][1].split()
    items = [(1, " ".join(base[10:30])), (2, "Two"), (2, " ".join(base[200:215]).upper()), (3, None), (4, ""), (None, "one"), (5, " ".join(base[10:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        for p in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[p : p + 10])] |= set() if i is None else {str(i)}  # an item without id has windows but no name
    want = []
    for i, t in texts():
        w, hit, found = norm(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        want.append((i, len(w), len(hit), sorted(found)))
    got = [tuple(r) for r in decontaminate.find(docs, bench, max_words=most, at_once=at_once).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = decontaminate.decontaminate(docs, bench, max_words=most)
    left = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and left == {i for i, n, h, _ in want if not n or h <= 0.5 * n} and 6 not in left
    assert decontaminate.find(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN).select("doc_id", "ids", F.col("ids").alias("kept")), path).collect()
    assert sorted(((r.doc_id, list(r.kept), bytes(r.decoded)) for r in got), key=repr) == sorted(((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts()), key=repr)


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", r"<\/s> <\\s> [\INST]", "[ROLE]x[/ROLE]", None, "", "a\nb", "<<SYS>", "[[INST]"]
    rows = [(1, k, ("user", "assistant")[k % 2], t, 0) for k, t in enumerate(hard)] + [(2, 1, None, "x", 0), (2, None, "tool [/ROLE]", "y", 0), (2, 1, None, "x", 0), (None, 0, "system", "z", 0)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns int")).withColumn("read", chat.read_turns(F.col("formatted")))
    got = {r.conv_id: ([tuple(t) for t in r.read], r.valid, [s.text for s in r.segments if s.loss]) for r in out.collect()}
    assert got[1][0] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(hard)] and got[1][1] and len(got[1][2]) == 4
    assert got[2][0] == [("tool [/ROLE]", "y"), ("", "x"), ("", "x")] and not got[2][1] and got[None][0] == [("system", "z")]


def test_secrets(spark):
    token = "9f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fd"
    rows = [(1, f'words token = "{token}" words', "src1"), (2, f"see commit {token} of the tree", None), (3, None, None), (4, "", None), (None, f"token: {token}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.secret for r in secret_scan.scan(df).collect()}
    assert got == {1: True, 2: False, None: True}
    red = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert red[1] == f'words token = "{secret_scan.MASK}" words' and red[2] == rows[1][1] and red[3] is None
    train, held = secret_scan.labelled(1), spark.createDataFrame(secret_scan.labelled(2), "value string, before string, path string, label int")
    trees = secret_scan.fit(spark, train)
    right = held.select((F.expr("label = 1") == (secret_scan.score(trees, secret_scan.features(F.col("value"), F.col("before"), F.col("path"))) >= 500)).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).first()[0] > 0.95


def test_urls(spark):
    rows = [(1, "HTTPS://A.Example.ORG/es/1?x=/"), (2, "https://example.org/en/12"), (3, "http://x.com/de/"), (4, None), (5, "no scheme"), (6, "http://a.org"), (7, "http://free-casino-bets.example.com/casino/bonus"), (7, "http://x.net#/y")]
    got = [tuple(r)[:4] + (r.verdict,) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).orderBy("page_id", "host").collect()]
    assert got[0] == (1, "a.example.org", "/es/1", "example.org/es/", "block") and got[1][3:] == ("example.org/en/1", "block") and got[2][3:] == ("com/de/", "block")
    assert got[3][1:4] == ("", "", None) and got[4][1:4] == ("", "", None) and got[5][:4] == (6, "a.org", "", None) and got[6][4] == "block" and got[7][:4] == (7, "x.net", "", None)


def test_warc(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/\n1", big), (2, None, big), (3, "http://c", big), (4, "d", "x"), (5, "e", "x"), (6, "f", None), (None, "g", big), (8, "h", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for k in range(2):
        manifest = warc.write(pages, str(tmp_path / f"w{k}"), shard_bytes=2000, roll_bytes=200)
        made.append(sorted(map(tuple, manifest.collect())))
    assert made[0] == made[1] and len(made[0]) > 2
    got = {r.page_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read(spark, str(tmp_path / "w0")).collect()}
    hexed = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == {i: (("revisit" if i in (1, 2, None) else "response"), len((t or "").encode()), hexed(t), 3 if i in (1, 2, None) else None) for i, _, t in rows}
    assert warc.write(pages.limit(0), str(tmp_path / "none")).count() == 0 and warc.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("ids", [[2 * i for i in range(1000)] + [1 << 60], [-(1 << 63), (1 << 63) - 1, *range(500)], [7] * 600 + [None] * 300 + [8]])
def test_warc_shards(spark, tmp_path, ids):
    rows = [(i, f"http://h/{k % 50}", "x" * 40) for k, i in enumerate(ids)]
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), shard_bytes=2000, roll_bytes=1 << 20).collect()
    per = collections.Counter()
    for r in manifest:
        per[r.shard] += r.records
    assert sum(per.values()) == len(ids) and max(per.values()) <= 90 and len(per) >= len(ids) * 40 // 2000
    assert sorted((r.page_id for r in warc.read(spark, str(tmp_path / "w")).collect()), key=repr) == sorted(ids, key=repr)


def test_redaction_by_place(spark):
    token = "9f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fd"
    text = f"token = {token} and, see commit {token} of; the (tree)"
    red = secret_scan.redact(spark.createDataFrame([(1, text, "src1"), (2, None, None), (3, "token =", "a")], "doc_id long, text string, source string"))
    assert {r.doc_id: r.text for r in red.collect()} == {1: text.replace(token, secret_scan.MASK, 1), 2: None, 3: "token ="}


STRUCTURED = "a"
for _ in range(11):
    STRUCTURED += STRUCTURED.translate(str.maketrans("ab", "ba"))


def test_structured_words_do_not_collide(spark):
    """Words of 2,048 bytes that collide under polynomials modulo 2**64, through the operators that hash words."""
    other = STRUCTURED.translate(str.maketrans("ab", "ba"))
    fill = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*fill[:30], STRUCTURED, *fill[30:]])), (2, " ".join([*fill[:30], other, *fill[30:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring.deduplicate(df).orderBy("doc_id").collect()] == [0, 0]
    bench = spark.createDataFrame([(1, " ".join([*["q"] * 9, STRUCTURED]))], "item_id long, text string")
    hit = decontaminate.find(spark.createDataFrame([(1, "q " * 9 + other), (2, "q " * 9 + STRUCTURED)], "doc_id long, text string"), bench)
    assert {r.doc_id: r.n_hit for r in hit.collect()} == {1: 0, 2: 10}
    five = "q r s t ".split()
    repeated = quality.judge(spark.createDataFrame([(1, " ".join([*five, STRUCTURED, *five, other]))], "doc_id long, text string")).first()
    assert repeated.n_repeat_words == 0


def test_quality_ratios_and_prose(spark):
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(900)]
    made = {n: " ".join(r.choice(words) for _ in range(n)) for n in (20, 300, 3000, 9000)}
    tail = made[9000][:16384] + "z" * 4000  # the last piece is under half a chunk and is judged with the one before
    rows = [*enumerate([*made.values(), "spam and eggs " * 40, tail, made[3000][:8000] + "ab " * 8000])]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        raw = text.encode()
        ratio = len(packer.compress(raw)) / len(raw)
        low, high = next((a, b) for least, a, b in reversed(quality.BANDS) if len(raw) >= least)
        edges = [*range(0, len(raw) - quality.CHUNK // 2 + 1, quality.CHUNK), len(raw)] if len(raw) > quality.CHUNK else [0, 0]
        parts = [len(packer.compress(raw[a:b])) / (b - a) for a, b in zip(edges, edges[1:]) if b > a]
        bad = sum(not quality.CHUNK_BAND[0] <= p <= quality.CHUNK_BAND[1] for p in parts) / max(1, len(parts))
        assert got[i].ratio == pytest.approx(ratio) and got[i].bad_chunks == pytest.approx(bad)
        assert got[i].kept == (low <= ratio <= high and bad <= quality.CHUNK_SHARE and not got[i].base_failed)
    import pathlib

    prose = [p.read_text(errors="ignore") for p in pathlib.Path("/usr/share/common-licenses").glob("*") if p.is_file()]
    plain = [x for x in prose if 1000 < len(x) < 100_000]
    if len(plain) > 3:
        kept = quality.judge(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).agg(F.avg(F.when(F.col("base_failed"), None).otherwise(F.col("kept").cast("int")))).first()[0]
        assert kept >= 0.95


def test_near_duplicates_against_all_pairs(spark):
    """Every link of documents at sf0.01: two texts are linked if 5-word shingles overlap by 0.8 or more, counted as multisets."""
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    texts = {}
    for i, t in rows:
        texts[t or ""] = min(i, texts.get(t or "", i))
    bags, where = [], collections.defaultdict(list)
    names = list(texts)
    for k, t in enumerate(names):
        w = WORDS.findall(t)
        bag = collections.Counter(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else collections.Counter()
        bags.append(bag)
        for s in bag:
            where[s].append(k)
    shared = collections.Counter((a, b) for ks in where.values() for x, a in enumerate(ks) for b in ks[x + 1 :])
    root = list(range(len(names)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for a, b in shared:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            links += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k, t in enumerate(names):
        least[find(k)] = min(texts[t], least.get(find(k), texts[t]))
    place = {t: k for k, t in enumerate(names)}
    want = {i: least[find(place[t or ""])] if WORDS.search(t or "") else i for i, t in rows}
    got = {x.doc_id: x.class_id for x in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links and got == want


def test_keep_one_with_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, long, 1), (5, "u " * 9, 2), (5, long, 3), (None, long, 4), (None, "n m o p q r", 5), (None, "n m o p q r", 6), (7, "", 7), (8, None, 8)]
    out = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _head int"))
    assert out.columns == ["doc_id", "text", "_head"] and sorted((r.doc_id, r.text) for r in out.where("doc_id is not null").collect() if r.text is not None) == [(3, long), (5, "u " * 9), (7, "")]
    assert [r.text for r in out.where("doc_id is null").collect()] == ["n m o p q r"] and out.where("doc_id = 8").count() == 1


def test_lm(spark, docs):
    got = lm.score(docs, P.path(queries.RANKS), P.PATTERN).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, WORDS.findall(lower(t or "")) + [None]) for i, t in texts()]
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in rows), key=repr)
    assert sorted(((*tuple(r)[:5], round(r.base_score, 5)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.startswith(("op1_", "op3_", "op4_", "op5_", "op8_", "op9_", "op10_"))])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and 0 < out.count() <= docs.count()
        docs = out
    assert [r.secret for r in secret_scan.scan(docs).collect()].count(True) == 0
