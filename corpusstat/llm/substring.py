"""Substring deduplication: words covered by a window that a document with a smaller id also has.

Anchors say which passages can share a window at all. The distinct passages that share them are the reference, dealt into shards; each shard's suffix automaton
is built in a task, and the documents' own passages are streamed through it for their matching statistics, which say where a window of theirs occurs and
which document is the least that has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusstat.llm import automaton as sa
from corpusstat.llm.blocks import Scratch, buffers, mapped, mix, run_hashes, signed, sliding, window_hashes, word_hashes, words

#: Words in an anchor. A window of n words holds n - ANCHOR + 1 candidates, of which the least hash is its anchor.
ANCHOR = 20
#: Words of the reference in a shard. Anchors with more of them (a passage in very many documents, with other words around it in each) are cut up by longer anchors, at last by whole windows.
SHARD = 60_000
#: Words that are streamed through one copy of a shard's automaton, on average.
STREAM = 600_000
LAST = (1 << 63) - 1


def anchored(block: pa.RecordBatch, n: int, k: int = ANCHOR):
    """Of each window of n words in one text: text number, first word's number in the block, anchor (of k words); and the words' places in the block."""
    data, offsets = buffers(block.column("text"))
    starts, ends, doc = words(data, offsets)
    if len(doc) < n:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), (data, starts, ends, doc, none.view(np.uint64))
    hashes = word_hashes(data, starts, ends)
    k = min(k, n)
    least = sliding(window_hashes(hashes, k), n - k + 1, np.minimum)
    at = np.flatnonzero(doc[: len(least)] == doc[n - 1 :])
    return doc[at], at, least[at], (data, starts, ends, doc, hashes)


def taken(block: pa.RecordBatch, name: str, at: np.ndarray) -> np.ndarray:
    return block.column(name).to_numpy(zero_copy_only=False)[at]


def anchors(block: pa.RecordBatch, n: int) -> pa.RecordBatch:
    doc, _, least, _ = anchored(block, n)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    return pa.RecordBatch.from_pydict({"anchor": signed(least[new]), "ord": taken(block, "ord", doc[new]), "row": taken(block, "row", doc[new])})


def passages(block: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """The runs of windows with one anchor, if that is in the text's list of shared ones: the first window's place, the number of windows, and the words
    that they cover, joined by one space."""
    doc, at, least, (data, starts, ends, of, hashes) = anchored(block, n)
    shared = block.column("shared")
    owner = np.repeat(np.arange(block.num_rows), shared.value_lengths().to_numpy(zero_copy_only=False))
    wanted = np.unique(mix(shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(owner.astype(np.uint64))))
    keys = mix(least ^ mix(doc.astype(np.uint64)))
    spot = np.minimum(np.searchsorted(wanted, keys), max(0, len(wanted) - 1))
    some = np.flatnonzero(wanted[spot] == keys) if len(wanted) else np.zeros(0, np.int64)
    first = np.ones(len(some), bool)
    first[1:] = (some[1:] != some[:-1] + 1) | (keys[some[1:]] != keys[some[:-1]])
    begin = np.flatnonzero(first)
    windows = np.diff(np.append(begin, len(some)))
    w = at[some[begin]]  # first words
    begun = np.searchsorted(of, np.arange(block.num_rows))
    d = doc[some[begin]]
    return runs_of(block, n, data, starts, ends, hashes, w, windows, d, least[some[begin]], (w - begun[d]).astype(np.int32))


def runs_of(block, n: int, data, starts, ends, hashes, w, windows, d, anchor, place) -> pa.RecordBatch:
    """Rows of passages: windows of texts d from the words w on."""
    raw = data.tobytes()
    texts = [b" ".join(raw[a:b].split()) for a, b in zip(starts[w].tolist(), ends[w + windows + n - 2].tolist())] if len(w) else []
    return pa.RecordBatch.from_pydict({
        "anchor": signed(anchor), "passage": signed(run_hashes(hashes, w, w + windows + n - 1)), "ord": taken(block, "ord", d), "row": taken(block, "row", d),
        "place": place, "windows": windows.astype(np.int32), "words": pa.array(texts, pa.binary()).cast(pa.string()),
    })


def cut_up(block: pa.RecordBatch, n: int, k: int) -> pa.RecordBatch:
    """Passages cut into those with one anchor of k words as well."""
    doc, at, least, (data, starts, ends, of, hashes) = anchored(block, n, k)
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    begin = np.flatnonzero(first)
    w, d = at[begin], doc[begin]
    begun = np.searchsorted(of, np.arange(block.num_rows))
    anchor = mix(taken(block, "anchor", d).view(np.uint64) ^ mix(least[begin]))
    return runs_of(block, n, data, starts, ends, hashes, w, np.diff(np.append(begin, len(doc))), d, anchor, (taken(block, "place", d) + w - begun[d]).astype(np.int32))


def solved(reference: pa.Table, streamed: pa.Table, n: int) -> pa.Table:
    """Where windows of the streamed passages also stand in a document with a smaller id. The automaton of a shard's reference holds with each state the least document of those whose passages reach it; each passage is
    streamed for its matching statistics, and where n words or more match, the state of the last n says which document is the least to have them. Passages of equal words are streamed once. A document gets one row,
    however many of its passages are found, so there are never more rows than documents or passages."""
    kinds = pa.schema([("ord", pa.int64()), ("row", pa.int64()), ("places", pa.list_(pa.int32()))])
    if not reference.num_rows or not streamed.num_rows:
        return kinds.empty_table()
    ids: dict[str, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in t.split(" ")] for t in reference.column("words").to_pylist()]
    step, link, length = sa.build(coded)
    least = [LAST] * len(link)
    for t, o in zip(coded, reference.column("least").to_pylist()):
        s = 0
        for token in t:
            s = step[s][token]
            if o < least[s]:
                least[s] = o
    by_length = sorted(range(1, len(link)), key=length.__getitem__)
    for s in reversed(by_length):
        if least[s] < least[link[s]]:
            least[link[s]] = least[s]
    top = [0] * len(link)  # the state of the last n words of what a state holds
    for s in by_length:
        top[s] = s if length[s] < n or length[link[s]] < n else top[link[s]]

    def leasts(text: str) -> list[int]:
        s = matched = 0
        out = []
        for word in text.split(" "):
            token = ids.get(word, -1)
            while s and token not in step[s]:
                s = link[s]
                matched = length[s]
            if token in step[s]:
                s = step[s][token]
                matched += 1
            out.append(least[top[s]] if matched >= n else LAST)
        return out[n - 1 :]

    known: dict[str, list[int]] = {}
    found: dict[tuple[int, int], list[int]] = {}
    for text, o, row, place in zip(*(streamed.column(c).to_pylist() for c in ("words", "ord", "row", "place"))):
        own = known.get(text)
        if own is None:
            own = known[text] = leasts(text)
        hit = [place + i for i, x in enumerate(own) if x < o]
        if hit:
            found.setdefault((o, row), []).extend(hit)
    return pa.table([pa.array([o for o, _ in found], pa.int64()), pa.array([row for _, row in found], pa.int64()), pa.array(list(found.values()), kinds.field("places").type)], schema=kinds)


def kept(block: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """The words that no listed window covers, joined by one space."""
    data, offsets = buffers(block.column("text"))
    raw, texts, counts, removed = data.tobytes(), [], [], []
    for a, b, places in zip(offsets[:-1].tolist(), offsets[1:].tolist(), block.column("places")):
        own = raw[a:b].split()  # of bytes: at \x20 and \x09-\x0D alone
        counts.append(len(own))
        if places.is_valid and len(own):
            cover = np.zeros(len(own) + 1, np.int64)
            places = np.unique(places.values.to_numpy(zero_copy_only=False))
            cover[places] += 1
            np.subtract.at(cover, places + n, 1)
            stays = np.cumsum(cover[:-1]) == 0
            own = [w for w, s in zip(own, stays.tolist()) if s]
        texts.append(b" ".join(own).decode())
        removed.append(counts[-1] - len(own))
    return pa.RecordBatch.from_pydict({"ord": block.column("ord"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.string())})


def deduplicate(docs: DataFrame, *, n: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD) -> DataFrame:
    r"""One row per row of docs: id, n_words, n_removed and `kept`, the words that stay joined by one space.

    A word goes if a window of n consecutive words covers it whose word sequence also starts in a
    document with a smaller id. Words are runs without \x20 and \x09-\x0D; windows are judged on the input.
    Each window has an anchor (of its runs of ANCHOR words the one with the least hash), so equal windows have equal anchors. A passage is a run of
    windows with one anchor that stands in several documents. Distinct passages are the reference, each with the least document that has it; those that share an anchor meet in a shard
    of some shard_words words. Each shard's suffix automaton goes to as many tasks as its passages need, and all documents' passages with the shard's anchors are streamed through it. Where the
    reference of one anchor is longer than a shard, its passages are cut up by anchors of more words, and at last by their windows, so no task holds more than a shard.

    Nulls: a null text has no words; a null id counts as greater than all others. Rows with equal ids
    never remove each other's words. Texts of any length are judged whole. Empty tables give no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("ord", "text"))
    several = [F.min("ord").alias("least"), F.max("ord").alias("most")]
    found = scratch.write("anchors", mapped(rows, lambda b: anchors(b, n), "anchor long, ord long, row long"))
    shared = scratch.write("shared-anchors", found.groupBy("anchor").agg(*several).where("least < most").select("anchor"))
    listed = found.join(shared, "anchor").groupBy("ord", "row").agg(F.collect_set("anchor").alias("shared"))
    kinds = "anchor long, passage long, ord long, row long, place int, windows int, words string"
    runs = scratch.write("passages", mapped(rows.join(listed, ["ord", "row"]), lambda b: passages(b, n), kinds))
    scratch.drop("anchors", "shared-anchors")
    key, parts = ["anchor", "passage"], []
    for k in (ANCHOR, (ANCHOR + n) // 2, n):
        if parts:
            runs = scratch.write(f"passages-{k}", mapped(runs.withColumnRenamed("words", "text"), lambda b, k=k: cut_up(b, n, k), kinds))
        references = scratch.write(f"references-{k}", runs.groupBy(*key).agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.first("windows").alias("windows"), F.first("words").alias("words"), F.count("*").alias("times")))
        size = F.col("windows") + n - 1
        sizes = references.groupBy("anchor").agg(F.sum(size).alias("size"), F.sum(size * F.col("times")).alias("streamed"), F.min("least").alias("least"), F.max("most").alias("most")).where("least < most")
        fits = F.lit(True) if k >= n else F.col("size") <= shard_words
        sizes = scratch.write(f"sizes-{k}", sizes.select("anchor", "size", "streamed", fits.alias("fits")))
        total = sizes.where("fits").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-2 * total // shard_words))
        placed = sizes.where("fits").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        copies = placed.groupBy("shard").agg(F.ceil(F.sum("streamed") / STREAM).cast("int").alias("copies"))
        placed = scratch.write(f"placed-{k}", placed.join(copies, "shard").select("anchor", "shard", "copies"))
        # An automaton is built in as many tasks as its stream needs; a passage goes to one of them. Both sides' keys are of one type, since 0 and 0L hash to different partitions.
        reference = references.join(placed, "anchor").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "least", "words")
        streamed = runs.join(placed, "anchor").select("shard", F.pmod(F.xxhash64("passage", "ord", "row", "place"), F.col("copies")).cast("int").alias("copy"), "ord", "row", "place", "words")
        reference, streamed = reference.toDF("shard", "copy", "least", "words"), streamed.toDF("shard", "copy", "ord", "row", "place", "words")
        met = reference.groupBy("shard", "copy").cogroup(streamed.groupBy("shard", "copy")).applyInArrow(lambda a, b: solved(a, b, n), "ord long, row long, places array<int>")
        parts.append(scratch.write(f"found-{k}", met))
        scratch.drop(f"references-{k}", f"placed-{k}")
        runs = runs.join(sizes.where("not fits").select("anchor"), "anchor")
        if sizes.where("not fits").isEmpty():
            break
    scratch.keep(*(name for name in scratch.paths if name.startswith("found-")))
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.union(part)
    places = gone.groupBy("ord", "row").agg(F.flatten(F.collect_list("places")).alias("places"))
    out = mapped(rows.join(places, ["ord", "row"], "left"), lambda b: kept(b, n), "ord long, n_words long, n_removed long, kept string")
    return out.select(F.nullif("ord", F.lit(LAST)).alias(id_col), "n_words", "n_removed", "kept")
