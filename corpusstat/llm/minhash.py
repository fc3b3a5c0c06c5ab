"""Near-duplicates by BagMinHash signatures of word shingles, banding, and a check of the multisets' overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusstat.llm.blocks import Scratch, buffers, lists, mapped, mix, run_hashes, signed, window_hashes, word_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 6 rows: a pair at similarity 0.8 shares no band with probability 0.0007.
BANDS, ROWS = 24, 6
#: Rounds in which each band that is still open compares its most famous node with the others; then rare_pairs compares what is left.
HUBS = 3
LAST = (1 << 63) - 1


def bag(block: pa.RecordBatch, column: str = "text"):
    """Text number, hash and count of each distinct shingle. A text of fewer words, but not none, is one shingle."""
    data, offsets = buffers(block.column(column))
    starts, ends, doc = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(doc, np.arange(block.num_rows + 1))
    n = np.diff(first)
    grams = window_hashes(hashes, SHINGLE)
    at = np.flatnonzero(doc[: len(grams)] == doc[len(doc) - len(grams) :])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    owner = np.concatenate([doc[at], short])
    gram = np.concatenate([grams[at], run_hashes(hashes, first[short], first[short + 1])])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])])) if len(gram) else np.zeros(0, np.int64)
    return owner[new], gram[new], np.diff(np.append(new, len(gram)))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(owner: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n rows of m BagMinHash values: two bags agree in a value with the probability of their weighted Jaccard similarity.

    Weights are discretised at 0, 1, 2, 4, 8 ...: each piece of a shingle's weight axis has a Poisson process of
    points (time, weight, component) whose rate is the piece's length, seeded by shingle and piece alone. A point counts if its
    weight is below the bag's. A component's value is the time of its earliest point. A piece is drawn from
    only while its next point could be earlier than the latest of its bag's components, which costs some m log m points and one for each piece
    however large the weights are."""
    pieces = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(gram)), pieces)
    level = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.where(level > 0, low, 1.0)
    bag_of, limit = owner[at], weight[at].astype(np.float64)
    seed = mix(gram[at] + mix(level.astype(np.uint64) + np.uint64(1)))
    time, drawn = np.zeros(len(at)), 0
    values = np.full(n * m, np.inf)
    live, draws = np.arange(len(at)), 1
    while len(live):
        point = np.arange(drawn + 1, drawn + draws + 1, dtype=np.uint64)
        r = mix(seed[live, None] + mix(point)[None, :])
        when = time[live, None] + np.cumsum(-np.log(unit(r)), axis=1) / length[live, None]
        r = mix(r)
        component = ((r >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts = low[live, None] + ((r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * length[live, None] < limit[live, None]
        slot = bag_of[live, None] * m + component
        np.minimum.at(values, slot[counts], when[counts])
        time[live] = when[:, -1]
        latest = values.reshape(n, m).max(axis=1)
        live = live[time[live] <= latest[bag_of[live]]]
        drawn += draws
        draws = min(2 * draws, max(1, (1 << 20) // max(1, len(live))), 64)
    return values.reshape(n, m)


def sketched(block: pa.RecordBatch) -> pa.RecordBatch:
    """Of each text the band keys (none if it has no words) and the size of its bag."""
    n = block.num_rows
    owner, gram, weight = bag(block)
    bits = signatures(owner, gram, weight, n).view(np.uint64).reshape(n, BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, BANDS))
    for i in range(ROWS):
        keys = mix(keys + bits[:, :, i])
    size = np.bincount(owner, weights=weight, minlength=n).astype(np.int64)
    some = size > 0
    offsets = np.concatenate([[0], np.cumsum(some * BANDS)])
    return pa.RecordBatch.from_pydict({"ord": block.column("ord"), "node": block.column("node"), "bands": lists(signed(keys[some].ravel()), offsets, pa.int64()), "size": size})


def overlap(block: pa.RecordBatch) -> pa.RecordBatch:
    """Of each pair of texts how many shingles both bags hold, and how many either holds."""
    n, parts = block.num_rows, []
    for column in ("hub_text", "text"):
        owner, gram, weight = bag(block, column)
        key = mix(gram ^ mix(owner.astype(np.uint64)))
        order = np.argsort(key)
        parts.append((key[order], owner[order], weight[order], np.bincount(owner, weights=weight, minlength=n)))
    (key, owner, weight, size), (other, _, other_weight, other_size) = parts
    at = np.minimum(np.searchsorted(other, key), max(0, len(other) - 1))
    same = np.flatnonzero(other[at] == key) if len(other) else np.zeros(0, np.int64)
    both = np.bincount(owner[same], weights=np.minimum(weight[same], other_weight[at[same]]), minlength=n)
    return pa.RecordBatch.from_pydict({"a": block.column("hub"), "b": block.column("node"), "both": both, "either": size + other_size - both})


def similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (hub, node) those whose bags' weighted Jaccard similarity reaches the threshold, as (a, b). The node's text is
    joined first, so that a hub's text is never shuffled with each of its many nodes."""
    joined = pairs.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub").select("hub", "node", "hub_text", "text")
    both = mapped(joined, overlap, "a long, b long, both double, either double")
    return both.where(F.col("both") >= threshold * F.col("either") - 1e-9).select("a", "b")


def element_lists(block: pa.RecordBatch) -> pa.RecordBatch:
    """The elements (shingle, occurrence) of each text's bag, as 64-bit hashes."""
    n = block.num_rows
    owner, gram, weight = bag(block)
    at = np.repeat(np.arange(len(gram)), weight)
    occurrence = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))])
    return pa.RecordBatch.from_pydict({"node": block.column("node"), "root": block.column("root"), "es": lists(signed(mix(gram[at] + mix(occurrence.astype(np.uint64)))), ends, pa.int64())})


def rare_pairs(bags: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """All pairs (hub, node) of nodes with different roots that can reach the threshold; bags has the elements of each (node, root). Of two bags this
    similar, each shares an element among its size - ceil(threshold * size) + 1 rarest ones with the other's, in one order of all elements;
    and what they share is no more than what stands from the first shared element on in either. Only pairs that pass both are made."""
    elements = scratch.write("elements", bags.select("node", "root", F.explode(F.array_distinct("es")).alias("e")))
    counts = scratch.write("element-counts", elements.groupBy("e").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed")))
    ranked = elements.join(counts, "e").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("n", "e", "mixed"))).alias("es")).withColumn("size", F.size("es"))
    rare = ranked.select("node", "root", "size", F.posexplode(F.slice("es", F.lit(1), F.col("size") - F.ceil(F.col("size") * threshold).cast("int") + 1)).alias("at", "x"))
    rare = scratch.write("rare-elements", rare.where("x.mixed").select("node", "root", "size", (F.col("size") - F.col("at")).alias("rest"), "x.e"))
    other = rare.select("e", F.col("node").alias("hub"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), F.col("rest").alias("x_rest"))
    fits = F.least("rest", "x_rest") * (1 + threshold) >= threshold * (F.col("size") + F.col("x_size")) - 1e-6  # rounding may only add candidates
    return rare.join(other, "e").where("node < hub and root <> x_root").where(fits).select("hub", "node").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node of each linked component. Every turn gives each node the least root next to it and
    then that root's own root; turns end when no root changes, and each is a written table."""
    edges = scratch.write("edges", links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = scratch.write("roots", edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(roots.withColumnsRenamed({"node": "b", "root": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = scratch.write("hooked", roots.join(near, "node", "left").select("node", "root", F.least("root", "near").alias("to")))
        up = hooked.select(F.col("node").alias("to"), F.col("to").alias("up"))
        after = scratch.write("roots", hooked.join(up, "to", "left").select("node", F.least("to", "up").alias("root"), (F.least("to", "up") < F.col("root")).alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("node", "root")
        roots = after.select("node", "root")


def linked(rows: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ord, node, bands, size) of each row (ord, node, text), and (node, text_id, class_id, head) of each distinct text with a word; head says
    which text of its class keep_one keeps."""
    sketches = scratch.write("sketches", mapped(rows, sketched, "ord long, node long, bands array<long>, size long"))
    nodes = scratch.write("nodes", sketches.where("size > 0").groupBy("node").agg(F.min("ord").alias("text_id"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    sizes = scratch.write("sizes", banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.write("bands", banded.join(sizes, "band"))
    fame = scratch.write("fame", members.groupBy("node").agg(F.sum("n").alias("fame")))
    members = scratch.write("members-0", members.select("band", "node", "size").join(fame, "node"))
    wanted = fame.join(nodes, "node").select("node", F.col("text_id").alias("ord"))  # one row of each text, so that copies stay where they are
    texts = scratch.write("texts", rows.join(wanted, ["node", "ord"], "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    scratch.drop("sizes", "bands", "fame")
    links, roots = None, fame.select("node", F.col("node").alias("root")).limit(0)
    near = F.least("size", "hub_size") >= threshold * F.greatest("size", "hub_size")  # else the bags can't be that similar
    for turn in range(HUBS + 1):
        # the bands with nodes of several components that no hub has met
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if turn else members.withColumn("root", F.col("node"))
        placed = scratch.write("placed", placed)
        mixed = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max_by(F.struct(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("root").alias("hub_root")), F.struct("fame", "node")).alias("hub"))
        mixed = scratch.write("mixed", mixed.where("least < most").select("band", "hub.*"))
        if turn and not mixed.limit(1).count():
            break
        if turn < HUBS:
            met = placed.join(mixed, "band")
            pairs = met.where("root <> hub_root").where(near).select("hub", "node").distinct()
            members = scratch.write(f"members-{turn + 1}", met.where("node <> hub").select("band", "node", "size", "fame"))
            scratch.drop(f"members-{turn}")
        else:
            left = placed.join(mixed, "band").select("node", "root").distinct()
            bags = mapped(texts.join(scratch.write("open-nodes", left), "node"), element_lists, "node long, root long, es array<long>")
            pairs = rare_pairs(bags, threshold, scratch)
        found = scratch.write(f"links-{turn}", similar(scratch.write("pairs", pairs), texts, threshold))
        links = found if links is None else links.union(found)
        roots = components(links, scratch)
    named = nodes.select("node", "text_id").join(roots, "node", "left").select("node", "text_id", F.coalesce("root", "node").alias("root"))
    named = scratch.write("named", named)
    least = scratch.write("classes", named.groupBy("root").agg(F.min(F.struct("text_id", "node")).alias("least")).select("root", F.col("least.text_id").alias("class_id"), F.col("least.node").alias("first")))
    named = scratch.write("named", named.join(least, "root").select("node", "text_id", "class_id", (F.col("node") == F.col("first")).alias("head")))
    scratch.keep("sketches", "named")
    return sketches, named


def prepared(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    rows = docs.select(*more, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("node", F.xxhash64("text"))


def classes(docs: DataFrame, *, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id (least id of the texts linked to it, directly or in a chain) and
    text_id (least id with exactly this text).

    Two texts are linked if the weighted Jaccard similarity of their bags of 5-word shingles is at
    least the threshold. Equal texts are one node. Nodes that share a band meet without all pairs of a group: each is compared with the
    band's most famous node (the one with the most company in all its bands, so the source of a group of copies). A band in which
    the others still are of several components compares the next one with them, HUBS times. Nodes of bands that are open even then meet where
    they share one of their rarest shingles (rare_pairs), which every similar pair does; so no pair of a band is untested
    unless a chain of links joins it already.

    Nulls: a null text is empty; an empty text is linked to nothing, not even to its copies (class_id and text_id are
    its own id); a null id stands last, and its class has the least id that is not null. Repeated rows have one class. Texts of any length are
    compared whole. Empty tables give no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sketches, named = linked(prepared(docs, id_col, text_col), threshold, scratch)
    out = sketches.select("ord", "node").join(named, "node", "left")
    return out.select(*(F.nullif(c, F.lit(LAST)).alias(name) for c, name in ((F.col("ord"), id_col), (F.coalesce("class_id", "ord"), "class_id"), (F.coalesce("text_id", "ord"), "text_id"))))


def keep_one(docs: DataFrame, *, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the least id (of several texts with that id, the one with the least hash). Rows without
    id stand last, so one stays where its class has no id. Empty texts are no copies of each other and stay. Where rows repeat an id and
    text, one stays. Columns as in docs, whatever they are called."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sketches, named = linked(prepared(docs, id_col, text_col), threshold, scratch)
    heads = named.where("head").select("node", F.col("text_id").alias("ord")).union(sketches.where("size = 0").select("node", "ord").distinct())
    rows = prepared(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).drop("text")
    kept = rows.join(heads, ["node", "ord"], "left_semi").dropDuplicates(["node", "ord"])
    return kept.select("row.*")
