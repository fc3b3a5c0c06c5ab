"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.llm import automaton as sa
from corpusstat.llm.blocks import LOWER, Scratch, buffers, counts_of, cut, lists, mapped, signed, word_hashes, words

#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def tokens(block: pa.RecordBatch, column: str = "text"):
    """Bytes, offsets, starts, ends, text numbers and 64-bit hashes of the normalised words."""
    data, offsets = buffers(block.column(column))
    lower = LOWER[data]
    starts, ends, doc = words(lower, offsets, BREAKS)
    return data, offsets, starts, ends, doc, word_hashes(lower, starts, ends)


def matcher(items: list[tuple[str | None, np.ndarray]], window: int) -> dict:
    """What the workers need of one block of items (name and word hashes), as arrays: the automaton, which items each
    state's window (or whole short item) belongs to, and the vocabulary and word pairs of the items. An item without a name belongs to none,
    but its words count."""
    vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
    texts = [np.searchsorted(vocabulary, h) for _, h in items]
    automaton = sa.build(t.tolist() for t in texts)
    _, link, length = automaton
    automaton = sa.flat(automaton, max(1, len(vocabulary)))
    by_length = sorted(range(1, len(link)), key=length.__getitem__)
    # the state that holds the last `window` tokens of what a state holds
    top = [0] * len(link)
    for s in by_length:
        top[s] = 0 if length[s] < window else s if length[link[s]] < window else top[link[s]]
    short: dict[int, tuple] = {}
    owners = set()
    for i, text in enumerate(texts):
        if 0 < len(text) < window:
            *_, (s, _) = sa.statistics(automaton, text.tolist())
            short[s] = (*short.get(s, ()), (len(text), items[i][0]))
        for s, n in sa.statistics(automaton, text.tolist()) if len(text) >= window else ():
            if n >= window and items[i][0] is not None:
                owners.add((top[s], i))
    for s in by_length if short else ():
        if link[s] in short:
            short[s] = tuple(dict.fromkeys((*short.get(s, ()), *short[link[s]])))
    owners = np.array(sorted(owners), np.int32).reshape(-1, 2)
    pairs = [t[:-1].astype(np.int64) * len(vocabulary) + t[1:] for t in texts if len(t) > 1]
    return {
        "automaton": automaton,
        "top": np.array(top, np.int32),
        "short": short,
        "owned": np.ascontiguousarray(owners[:, 0]),
        "owner": np.ascontiguousarray(owners[:, 1]),
        "names": [name for name, _ in items],
        "vocabulary": vocabulary,
        "pairs": np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64),
        "least": min([window, *(len(t) for t in texts if len(t))]),
        "window": window,
    }


def inside(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return at, table[at] == values if len(table) else np.zeros(len(values), bool)


def hits(m: dict, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
    """Which words lie in an occurring window, and the items found by text number.

    A match of n words is a run of words of the vocabulary of which each neighbouring pair is a
    pair of some item. Only runs at least as long as the shortest window enter the automaton:
    outside them its longest match is too short to count."""
    hit, found = np.zeros(len(hashes) + 1, np.int64), {}
    if not len(hashes) or not len(m["vocabulary"]):
        return hit[:-1].astype(bool), found
    ids, known = inside(hashes, m["vocabulary"])
    joined = np.zeros(len(ids), bool)  # to the next word
    joined[:-1] = known[:-1] & known[1:] & (doc[:-1] == doc[1:])
    at = np.flatnonzero(joined)
    joined[at] = inside(ids[at].astype(np.int64) * len(m["vocabulary"]) + ids[at + 1], m["pairs"])[1]
    before = np.concatenate([[False], joined[:-1]])
    starts, ends = np.flatnonzero(known & ~before), np.flatnonzero(known & ~joined) + 1
    long = ends - starts >= m["least"]
    window, top, short, names_of, owned, owner = m["window"], m["top"], m["short"], m["names"], m["owned"], m["owner"]
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        states = []
        for i, (s, n) in enumerate(sa.statistics(m["automaton"], ids[a:b].tolist()), a + 1):
            if n >= window:
                hit[i - window] += 1
                hit[i] -= 1
                states.append(s)
            for k, name in short.get(s, ()):
                if k <= n:
                    hit[i - k] += 1
                    hit[i] -= 1
                    if name is not None:
                        found.setdefault(int(doc[a]), set()).add(name)
        if states:
            states = np.unique(top[states])
            spans = zip(np.searchsorted(owned, states).tolist(), np.searchsorted(owned, states, "right").tolist())
            found.setdefault(int(doc[a]), set()).update(names_of[i] for x, y in spans for i in owner[x:y].tolist())
    return np.cumsum(hit[:-1]) > 0, found


def hashed(block: pa.RecordBatch) -> pa.RecordBatch:
    """The word hashes of each item."""
    *_, doc, hashes = tokens(block)
    ends = np.concatenate([[0], np.cumsum(counts_of(doc, block.num_rows))])
    return pa.RecordBatch.from_pydict({"item_id": block.column("item_id"), "hashes": lists(signed(hashes), ends, pa.int64())})


def matchers(benchmark: DataFrame, window: int, max_words: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(block, matcher) for blocks of the items of at most max_words words (or, of a longer item, that one alone); each is built by a task. The
    number of blocks doubles until no block is larger."""
    items = scratch.write("items", mapped(benchmark, hashed, "item_id string, hashes array<long>"))
    key, size = F.xxhash64("item_id", "hashes"), F.size("hashes")
    blocks = 1
    while True:
        sums = items.groupBy(F.pmod(key, F.lit(blocks)).alias("block")).agg(F.sum(size).alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
        if not sums.where((F.col("n") > max_words) & (F.col("a") < F.col("b"))).limit(1).count():
            break
        blocks *= 2

    def built(table):
        have = [(name, np.array(h, np.int64).view(np.uint64)) for name, h in zip(table.column("item_id").to_pylist(), table.column("hashes").to_pylist())]
        return pa.table({"block": table.column("block")[:1], "matcher": pa.array([pickle.dumps(matcher(have, window))], pa.binary())})

    made = items.select(F.pmod(key, F.lit(blocks)).alias("block"), "item_id", "hashes").distinct().groupBy("block").applyInArrow(built, "block long, matcher binary")
    return scratch.write("matchers", made), blocks


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 10, max_words: int = 200_000, at_once: int = 8, keep: list[str] | None = None, clean: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (ids found, as sorted strings), the columns
    of keep, and with clean=True `cleaned`: the text without the words that are hit (from the first
    byte of a hit span to the last; what stands between is kept as it is).

    A window is `window` consecutive words of an item; a shorter item is one window, an item
    without words none. Tasks build an automaton for each block of max_words words of items; at_once of them are broadcast together, which bounds a
    broadcast whatever the benchmark's size. Further blocks are further passes over the rows, without a shuffle, and each pass but the last is a written table.
    Nulls: a null text has no words; the windows of an item without id are hits, but it has no id to be named; a null document id is kept as it is.
    Texts of any length are judged whole. Repeated rows and repeated item ids are judged row by row and reported as one id. No rows of `docs`, or of
    `benchmark`: no rows, or no hits. Other columns of either table are ignored."""
    sc, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "decontaminate")
    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    keep = keep or []
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)),
                     F.lit(0).cast("long").alias("_n"), F.array().cast("array<int>").alias("_hit"), F.array().cast("array<string>").alias("_items"))
    made, blocks = matchers(rows, window, max_words, scratch)

    def run(shared, last):
        def f(batches):
            ms = shared.value
            for batch in batches:
                for block in cut(batch, "_text"):
                    yield judged(block, ms, last, clean)

        return f

    schema = df.schema
    for k in range(0, blocks, at_once):
        last = k + at_once >= blocks
        if last:
            schema = df.drop("_hit", *([] if clean else ["_text"])).withColumn("_hits", F.lit(0).cast("long")).schema
        shared = sc.broadcast([pickle.loads(r.matcher) for r in made.where((F.col("block") >= k) & (F.col("block") < k + at_once)).collect()] or [matcher([], window)])
        df = df.mapInArrow(run(shared, last), schema)
        if not last:
            df = scratch.write("pass", df)
            shared.unpersist()
    scratch.keep("pass")
    named: list[Column] = [F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_hits").alias("n_hit"), F.col("_items").alias("items")]
    return df.select(*named, *(F.col(f"_keep_{i}").alias(k) for i, k in enumerate(keep)), *([F.col("_text").alias("cleaned")] if clean else []))


def judged(block: pa.RecordBatch, ms: list[dict], last: bool, clean: bool) -> pa.RecordBatch:
    """The block with these matchers' hits added to those of the passes before."""
    data, offsets, starts, ends, doc, hashes = tokens(block, "_text")
    n = block.num_rows
    hit, found = hits(ms[0], doc, hashes)
    for m in ms[1:]:
        more, names = hits(m, doc, hashes)
        hit |= more
        for i, x in names.items():
            found.setdefault(i, set()).update(x)
    first = np.searchsorted(doc, np.arange(n + 1))
    for i, earlier in enumerate(block.column("_hit").to_pylist()):
        for k in earlier:
            hit[first[i] + k] = True
    items = [sorted({*old, *found.get(i, ())}) for i, old in enumerate(block.column("_items").to_pylist())]
    cols = {name: block.column(name) for name in block.schema.names} | {"_n": pa.array(counts_of(doc, n)), "_items": pa.array(items, pa.list_(pa.string()))}
    per_doc = np.bincount(doc[hit], minlength=n).astype(np.int64)
    if not last:
        at = np.flatnonzero(hit)
        cols["_hit"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), pa.array(at - first[doc[at]], pa.int32()))
        return pa.RecordBatch.from_pydict(cols)
    cols["_hits"] = pa.array(per_doc)
    del cols["_hit"]
    if not clean:
        del cols["_text"]
    elif hit.any():
        texts = cols["_text"].to_pylist()
        for i in np.flatnonzero(per_doc).tolist():
            a, b = first[i], first[i + 1]
            h = np.concatenate([[False], hit[a:b], [False]])
            edges = np.flatnonzero(h[1:] != h[:-1])
            out, at = [], int(offsets[i])
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                out.append(data[at : starts[a + s]].tobytes())
                at = int(ends[a + e - 1])
            texts[i] = b"".join([*out, data[at : offsets[i + 1]].tobytes()]).decode()
        cols["_text"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_pydict(cols)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, max_coverage: float = 0.5, **options) -> DataFrame:
    """docs without the spans of benchmark items; a document of which more than max_coverage of the
    words are hit goes as a whole. Columns as in docs. Nulls, ties and empty tables: see find()."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    names = {c: f"rest_{i}" for i, c in enumerate(rest)}
    out = find(docs.withColumnsRenamed(names), benchmark, keep=list(names.values()), clean=True, **options)
    out = out.where((F.col("n_words") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    return out.select(*(F.col("cleaned").alias(c) if c == text_col else F.col(c) if c == id_col else F.col(names[c]).alias(c) for c in docs.columns))
