"""Language-model scores: a causal self-attention model over words, mixed with the corpus's word counts.

The model is trained on all training texts: in each of ROUNDS rounds the tasks go on from the last round's model over their shares of
the round's texts, a block at a time, and Spark averages what they have learnt by the number of words. Texts of any length are cut into
windows. Word counts and the mixture's share come from all training texts too. The most frequent words have a target of their own; all others, known or not,
share one, and their part of it is that of their counts, as in the base score.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.llm.blocks import LOWER, buffers, cut, lists, signed, spans, translated, word_hashes, written

SEED = 11
#: Disjoint parts of the training texts, by hash; after each the tasks' models are averaged. Windows in a task's first step, and the step size.
ROUNDS, BATCH, RATE = 4, 32, 0.015
#: Steps after which another BATCH windows are added to each, and windows in a step at most.
GROW, MOST = 8, 256
#: Floats in a slice of a model that is averaged.
SLICE = 4096
#: Bins of log(attention / count's share) that the mixture's share is fitted on, from -LOGS to LOGS.
BINS, LOGS = 4096, 40.0
#: Positions of a context window, and of these how many at its end are scored.
WINDOW, SCORED = 64, 48
#: Width, classes of the two-level softmax, and members of a class.
WIDTH, CLASSES, MEMBERS = 16, 64, 64
#: Windows, targets of one softmax and weights whose arrays fit a core's cache. A product of more than 10**6 multiplications (PLACES * MEMBERS * (WIDTH + 1)
#: are fewer) is copied into another order first, which takes longer than the product.
INNER, PLACES, WEIGHTS = 48, 768, 1 << 14
#: Words with at least 1/FREQUENT of all tokens are broadcast, so at most FREQUENT words besides those with a target of their own.
FREQUENT = 1 << 20
#: Bytes of text in a block: large, so that the windows of many texts are dealt into steps.
LARGE = 1 << 19
#: Stands for the end of a text: the hash of no word.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def tokens(block: pa.RecordBatch):
    """The number of tokens of each text, and hashes of its words in lower case, with END after each text."""
    data, offsets = buffers(block.column("text"))
    data = translated(data, LOWER)
    starts, ends = spans(data, offsets)
    at = np.searchsorted(starts, offsets[1:])
    return np.diff(at, prepend=0) + 1, np.insert(word_hashes(data, starts, ends), at, END)


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each window's inputs (-1: none) and of what it scores, for sequences of n codes that stand one after the other.
    Each place is scored once, at the end of a window whose first WINDOW - SCORED inputs are the overlap."""
    per = -(-n // SCORED)
    seq = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    base, size = (np.cumsum(n) - n)[seq], n[seq]
    at = (k * SCORED - (WINDOW - SCORED))[:, None] + np.arange(WINDOW)
    good = (at >= 0) & (at < size[:, None])
    return np.where(good, base[:, None] + at, -1), good


def ready(m: dict) -> dict:
    """What a model's steps are made of. Q and K stand side by side, as do V and O, so each pair is one matrix; biases are rows for a last input of 1."""
    r = {"E": widened(m["E"], 1), "P": widened(m["P"], 0), "QK": m["Q"] @ m["K"].T, "VO": m["V"] @ m["O"], "mask": m["mask"]}
    r |= {"C": np.concatenate([m["C"], m["c"][None]]), "M": np.concatenate([m["M"], m["m"][:, None]], axis=1)}
    r |= {"CT": m["C"].T.copy(), "MT": m["M"].transpose(0, 2, 1).copy()}
    r["longest"] = longest(m["E"]) + longest(m["P"])  # no input is longer
    return r | {"lengths": longest(m["C"].T), "most": m["c"].max(), "members": np.sqrt(np.einsum("cij,cij->cj", m["M"], m["M"])), "own": m["m"]}


def widened(x: np.ndarray, by: float) -> np.ndarray:
    """x with a last column of the one value."""
    return np.concatenate([x, np.full((*x.shape[:-1], 1), by, x.dtype)], axis=-1)


def forward(r: dict, inputs: np.ndarray, good: np.ndarray):
    """Hidden states [windows, SCORED, WIDTH + 1], the last of them 1, and what the gradient needs."""
    x = r["E"].take(inputs, axis=0)
    x += r["P"]
    across = np.ascontiguousarray(x.transpose(0, 2, 1))
    y = np.ascontiguousarray(x[:, WINDOW - SCORED :])
    q = times(y[..., :WIDTH], r["QK"])
    a = q @ across[:, :WIDTH]
    if longest(q) * r["longest"] > 60:
        np.minimum(a, np.float32(60), out=a)
    np.exp(a, out=a)
    a *= r["mask"]  # what stands later
    a[np.flatnonzero(~good[:, 0]), :, : WINDOW - SCORED] = 0  # before a text's beginning
    c = a @ x
    total = c[..., WIDTH:] + np.float32(1e-30)
    c /= total
    y[..., :WIDTH] += times(c[..., :WIDTH], r["VO"])
    return y, (x, across, q, a, total, c)


def longest(x: np.ndarray) -> float:
    """Length of the longest row."""
    return float(np.sqrt(np.einsum("...i,...i->...", x, x).max(initial=0)))


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ ones(x.shape[-1], x.dtype)


@cache
def ones(n: int, kind: np.dtype) -> np.ndarray:
    return np.ones(n, kind)


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of two matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[-1])


def outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over windows and places of the outer products of x and y."""
    return (x.transpose(0, 2, 1) @ y).sum(0)


def picked(z: np.ndarray, at: np.ndarray, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax of the picked entry of each row, and the sums of exp(z), which takes the place of z. The sums cannot vanish, since centred rows have an entry of 0 or more. No entry is above the bound."""
    if bound > 80 and z.max(initial=0) > 80:  # they could overflow
        z -= z.max(axis=1, keepdims=True)
    own = z[np.arange(len(at)), at]
    np.exp(z, out=z)
    total = row_sums(z)
    return own - np.log(total), total


def softmax(h: np.ndarray, w: np.ndarray, at: np.ndarray, bound: float, back: np.ndarray, dh: np.ndarray | None, g: np.ndarray | None) -> np.ndarray:
    """Log softmax of the picked entry of each row of h @ w. Its gradients are added to dh and g, if there are any; back is w's other direction, without biases."""
    z = h @ w
    own, total = picked(z, at, bound)
    if g is not None:
        z /= total[:, None]
        z[np.arange(len(at)), at] = np.exp(own) - 1
        g += h.T @ z
        dh += z @ back
    return own


def log_probs(r: dict, h: np.ndarray, goals: np.ndarray, gradient: bool = False):
    """Natural log probability of each target (class * MEMBERS + member; -1: none) given its state, and on demand the gradients.
    Targets are sorted by class and taken PLACES at a time, which fit a core's cache."""
    at = np.flatnonzero(goals.ravel() >= 0)
    target = goals.ravel()[at]
    cls = target // MEMBERS
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    at = at[order]
    y, cls, member = h.reshape(-1, WIDTH + 1).take(at, axis=0), cls[order].astype(np.intp), (target - MEMBERS * cls)[order].astype(np.intp)
    most = longest(y[:, :WIDTH])
    bounds = (most * r["members"] + r["own"]).max(axis=1).tolist()
    own = np.empty(len(y), y.dtype)
    g = {"C": np.zeros_like(r["C"]), "M": np.zeros_like(r["M"])} if gradient else {}
    d = np.zeros((len(y), WIDTH), y.dtype) if gradient else None
    for a in range(0, len(y), PLACES):
        some = slice(a, a + PLACES)
        own[some] = softmax(y[some], r["C"], cls[some], most * r["lengths"] + r["most"], r["CT"], d[some] if gradient else None, g.get("C"))
    edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        for a in range(edges[c], edges[c + 1], PLACES):
            some = slice(a, min(a + PLACES, edges[c + 1]))
            own[some] += softmax(y[some], r["M"][c], member[some], bounds[c], r["MT"][c], d[some] if gradient else None, g["M"][c] if gradient else None)
    out = np.empty_like(own)
    out[order] = own
    if not gradient:
        return out, None, g
    dh = np.zeros((h.size // (WIDTH + 1), WIDTH), h.dtype)
    dh[at] = d
    return out, dh.reshape(*h.shape[:-1], WIDTH), g


def backward(r: dict, dh: np.ndarray, saved, g: dict) -> np.ndarray:
    """Adds to the gradients of QK and VO; returns that of the inputs."""
    x, across, q, a, total, c = saved
    g["VO"] += outer(c[..., :WIDTH], dh)
    dc = times(dh, widened(r["VO"].T, 0))
    dc /= total
    dc[..., WIDTH] = -np.einsum("...i,...i->...", dc, c)  # less the mean of da under a
    da = dc @ across
    da *= a
    dq = da @ x[..., :WIDTH]
    g["QK"] += outer(x[:, WINDOW - SCORED :, :WIDTH], dq)
    dx = da.transpose(0, 2, 1) @ q
    dx += a.transpose(0, 2, 1) @ dc[..., :WIDTH]
    dx[:, WINDOW - SCORED :] += dh + times(dq, r["QK"].T)
    return dx


def gradients(m: dict, r: dict, inputs: np.ndarray, goals: np.ndarray, good: np.ndarray, g: dict) -> np.ndarray:
    """Log probabilities of the targets; g gets the gradient of their negative sum. A few windows at a time fit a core's cache."""
    parts = [slice(k, k + INNER) for k in range(0, len(inputs), INNER)]
    states = [forward(r, inputs[p], good[p]) for p in parts]
    lp, dh, soft = log_probs(r, np.concatenate([h for h, _ in states]), goals, gradient=True)
    pairs = {"QK": np.zeros_like(r["QK"]), "VO": np.zeros_like(r["VO"])}
    dx = np.concatenate([backward(r, dh[p], saved, pairs) for p, (_, saved) in zip(parts, states)])
    g["Q"][:], g["K"][:] = pairs["QK"] @ m["K"], pairs["QK"].T @ m["Q"]
    g["V"][:], g["O"][:] = pairs["VO"] @ m["O"].T, m["V"].T @ pairs["VO"]
    g["C"][:], g["c"][:], g["M"][:], g["m"][:] = soft["C"][:WIDTH], soft["C"][WIDTH], soft["M"][:, :WIDTH], soft["M"][:, WIDTH]
    g["P"][:], g["E"][:] = dx.sum(0), 0
    at = inputs.ravel().astype(np.int16)
    order = np.argsort(at, kind="stable")
    begin = np.flatnonzero(np.diff(at[order], prepend=np.int16(-1)))
    g["E"][at[order[begin]]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), begin)
    return lp


#: What a model learns; the rest follows from the counts.
LEARNT = ("E", "P", "Q", "K", "V", "O", "C", "M", "c", "m")


def centred(m: dict) -> dict:
    """m, with each softmax's entries less their mean, in place. No probability changes, but without it long training moves all entries of a row down
    until exp is 0 for each of them."""
    for k in ("C", "c", "M", "m"):
        m[k] -= m[k].mean(axis=-1, keepdims=True)
    return m


def initial(counts: np.ndarray, seed: int = SEED, others: int | None = None) -> dict:
    """The untrained model for these counts of codes. The CLASSES * MEMBERS - 1 most frequent codes have a target of their own, the others share
    the last one, divided by their counts. others: the last code stands for so many words without a code, which share the last target in any case."""
    rng = np.random.default_rng(seed)
    own = np.argsort(-counts if others is None else -counts[:-1], kind="stable")[: CLASSES * MEMBERS - 1]
    target = np.full(len(counts), CLASSES * MEMBERS - 1, np.int32)
    target[own] = np.arange(len(own))
    rest = np.where(target == CLASSES * MEMBERS - 1, counts + 0.1, 0)
    if others is not None:
        rest[-1] += 0.1 * others
    whole = rest.sum()
    rest = np.log(np.where(rest > 0, rest / max(1e-9, whole), 1)).astype(np.float32)
    spread = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    m = {"E": spread(CLASSES * MEMBERS + 1, WIDTH), "P": spread(WINDOW, WIDTH), "Q": spread(WIDTH, WIDTH), "K": spread(WIDTH, WIDTH), "V": spread(WIDTH, WIDTH), "O": spread(WIDTH, WIDTH)}
    m |= {"C": spread(WIDTH, CLASSES), "M": spread(CLASSES, WIDTH, MEMBERS)}
    seen = np.bincount(target, weights=counts, minlength=CLASSES * MEMBERS).reshape(CLASSES, MEMBERS) + 0.1
    m |= {"c": np.log(seen.sum(1) / seen.sum()).astype(np.float32), "m": np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32)}
    at = np.arange(WINDOW)
    return centred(m) | {"mask": (at[None, :] <= at[WINDOW - SCORED :, None]).astype(np.float32), "target": target, "rest": rest, "whole": whole}


class Trainer:
    """Goes on from a model, by Adam, with the learning rate of the round."""

    def __init__(self, m: dict, turn: int, seed: int = SEED):
        self.flat = np.concatenate([m[k].ravel() for k in LEARNT]).astype(np.float32)
        ends = np.cumsum([m[k].size for k in LEARNT]).tolist()
        self.first, self.second, self.grad, self.other, self.step = *np.zeros((4, len(self.flat)), np.float32), 0
        self.m, self.parts = m, {}
        for k, b in zip(LEARNT, ends):
            self.m, self.parts[k] = self.m | {k: self.flat[b - m[k].size : b].reshape(m[k].shape)}, self.grad[b - m[k].size : b].reshape(m[k].shape)
        centred(self.m)
        self.rate, self.rng, self.seen = RATE * (1 - 0.9 * turn / ROUNDS), np.random.default_rng(seed + turn), 0

    def __call__(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Learns from sequences of n codes; returns the log probability of each code before the step that it was in."""
        m = self.m
        inputs, goals, good = batches(m, codes, n)
        real = (goals >= 0).sum(1)
        begin = np.cumsum(real) - real
        out = np.zeros(len(codes))
        order, at = self.rng.permutation(len(inputs)), 0
        while at < len(order):
            size = min(MOST, BATCH * (1 + self.step // GROW))
            size = len(order) - at if len(order) - at < 1.5 * size else size  # no small rest
            some = order[at : at + size]
            at += size
            own = real[some]
            lp = gradients(m, ready(m), inputs[some], goals[some], good[some], self.parts)
            out[np.repeat(begin[some] - np.cumsum(own) + own, own) + np.arange(len(lp))] = lp
            self.learn(max(1, len(lp)))
        self.seen += len(codes)
        return out + m["rest"][codes]

    def learn(self, n: int) -> None:
        """A step of Adam by the gradient's sum over n codes."""
        self.step += 1
        unbiased = (1 - 0.99**self.step) ** 0.5
        for k in range(0, len(self.flat), WEIGHTS):
            grad, first, second, flat, other = (x[k : k + WEIGHTS] for x in (self.grad, self.first, self.second, self.flat, self.other))
            grad *= np.float32(0.1 / n)
            first *= np.float32(0.9)
            first += grad
            grad *= grad
            second *= np.float32(0.99)
            second += grad
            np.sqrt(second, out=other)
            other += np.float32(1e-8 * unbiased)
            np.divide(first, other, out=other)
            other *= np.float32(self.rate * min(1, self.step / 20) / (1 - 0.9**self.step) * unbiased)
            flat -= other
        centred(self.m)

    def slices(self) -> pa.RecordBatch:
        """The model in slices, each weighted by the codes that it was trained on."""
        flat = np.concatenate([self.m[k].ravel() for k in LEARNT]).astype(np.float64) * self.seen
        parts = [flat[k : k + SLICE].tobytes() for k in range(0, len(flat), SLICE)]
        return pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int32()), "weight": np.full(len(parts), float(self.seen)), "w": pa.array(parts, pa.binary())})


def summed(table: pa.Table) -> pa.Table:
    """One slice's sum, in an order that doesn't hang on how its parts arrived."""
    table = table.sort_by([("weight", "ascending"), ("w", "ascending")])
    total = np.zeros(len(table.column("w")[0].as_py()) // 8)
    for w in table.column("w"):
        total += np.frombuffer(w.as_py())
    return pa.table({"slice": table.column("slice")[:1], "weight": [float(np.sum(table.column("weight").to_numpy()))], "w": pa.array([total.tobytes()], pa.binary())})


def averaged(m: dict, slices: DataFrame) -> tuple[dict, np.ndarray]:
    """The model that the tasks' slices average to (m itself where nothing was learnt from), and the sum of slices -1.

    Each task gives every slice once, so a slice is summed up in two steps, of about as many parts as each has slices: the square root of the tasks' number."""
    tasks = slices.groupBy("slice").count().agg(F.max("count")).first()[0] or 1
    parts = F.pmod(F.xxhash64("w"), F.lit(int(np.ceil(np.sqrt(tasks))))).alias("part")
    half = slices.select("slice", "weight", "w", parts).groupBy("slice", "part").applyInArrow(lambda t: summed(t.select(["slice", "weight", "w"])), "slice int, weight double, w binary")
    rows = {r.slice: r for r in half.groupBy("slice").applyInArrow(summed, "slice int, weight double, w binary").collect()}
    ratios = rows.pop(-1, None)
    if not rows:
        return m, np.zeros(BINS)
    flat, out, at = np.concatenate([np.frombuffer(rows[k].w) for k in sorted(rows)]) / rows[0].weight, dict(m), 0
    for k in LEARNT:
        out[k] = flat[at : at + m[k].size].reshape(m[k].shape).astype(np.float32)
        at += m[k].size
    return out, np.frombuffer(ratios.w)


def share_of(ratios: np.ndarray) -> float:
    """The attention's share that makes the training tokens likeliest (EM), given how many have which bin of log(attention / count's share)."""
    odds = np.exp((np.arange(BINS) + 0.5) * (2 * LOGS / BINS) - LOGS)
    share = 0.5
    for _ in range(30 if ratios.sum() else 0):
        share = float(np.clip(np.average(share * odds / (share * odds + 1 - share), weights=ratios), 0.05, 0.95))
    return share


def batches(m: dict, codes: np.ndarray, n: np.ndarray):
    """Inputs (the code before each place; CLASSES * MEMBERS begins a text), targets (-1: none) and good inputs of each window."""
    target = m["target"][codes]
    before = np.concatenate([np.zeros(1, np.intp), target[:-1]])
    before[(np.cumsum(n) - n)[n > 0]] = CLASSES * MEMBERS
    at, good = windows(n)
    return np.where(good, before[at], 0), np.where(good, target[at], -1)[:, WINDOW - SCORED :], good


def code_scores(m: dict, codes: np.ndarray, n: np.ndarray, windows_at_once: int = 384, inner: int = INNER) -> np.ndarray:
    """Natural log probability of each code of the sequences."""
    inputs, goals, good = batches(m, codes, n)
    r, out = ready(m), []
    for k in range(0, len(inputs), windows_at_once):
        to = min(k + windows_at_once, len(inputs))
        h = np.concatenate([forward(r, inputs[j : min(j + inner, to)], good[j : min(j + inner, to)])[0] for j in range(k, to, inner)])
        out.append(log_probs(r, h, goals[k:to])[0])
    return np.concatenate(out) + m["rest"][codes] if out else np.zeros(0)


def begins(keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys with each beginning (a number of bits, for at most as many keys as beginnings) stand."""
    bits = len(keys).bit_length() + 1
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def coded(hashes: np.ndarray, keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of the words in the sorted keys, which begins() gave begin for; len(keys) for all others."""
    last = np.append(keys, np.uint64(2**64 - 1))
    at = begin.take((hashes >> np.uint64(65 - len(begin).bit_length())).view(np.int64))
    left = np.flatnonzero(last.take(at) < hashes)
    while len(left):
        at[left] += 1
        left = left[last.take(at[left]) < hashes[left]]
    return np.where(last.take(at) == hashes, at, len(keys))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def counted(batches):
    """Counts of the words of all rows of a task, given out whenever many have gathered."""
    have, n = [], 0

    def summed():
        keys, place = np.unique(np.concatenate([k for k, _ in have]), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate([c for _, c in have])).astype(np.int64)

    def rows(keys, c):
        return pa.RecordBatch.from_pydict({"word": signed(keys), "c": c})

    for batch in batches:
        for block in cut(batch, "text", LARGE):
            have.append(np.unique(tokens(block)[-1], return_counts=True))
            n += len(have[-1][0])
            if n > 500_000:
                have = [summed()]
                n = len(have[0][0])
                if n > 250_000:
                    yield rows(*have[0])
                    have, n = [], 0
    if have:
        yield rows(*summed())


def score(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""One row per row of docs: id, held_out (crc32 of the id as text is a multiple of 10), n_tokens, n_known, train_tokens,
    base_score and score (log10).

    Tokens are the words without \x20 and \x09-\x0D, A-Z in lower case, and one end of each text. Counts are of all texts
    that aren't held out. base_score: the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))). score: of each token
    log10(share * attention + (1 - share) * (c + 0.1) / (N + 0.1 * (V + 1))). Attention is the softmax's entry of a word with a target of its own; any other word gets
    the entry that these words share times (c + 0.1) / (n + 0.1 * (v + 1)), with n and v the number and the kinds of their tokens. The share is fitted on the
    training texts: attention as each task's model had it before it learnt from the token, and counts without the token itself.
    The model depends on how the rows are dealt out to tasks.
    Frequent words (a fixed share of all tokens, so of bounded number) are looked up in the tasks, the others' counts are joined. path and pattern, a vocabulary of subwords, are no longer read.

    Nulls: a null text is empty and has its end alone; a null id trains. Repeated rows are scored one by one and count as often as they
    stand there. No rows give no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held", held_out(F.col("_id")))
    training = rows.where(~F.col("held"))
    counts = written(training.select("text").mapInArrow(counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    most = counts.orderBy(F.desc("c"), F.col("word") < 0, "word").limit(CLASSES * MEMBERS - 1).collect()  # of equal counts those that initial() takes
    common = {r.word: r.c for r in most + counts.where(F.col("c") * FREQUENT >= total).collect()}  # at most FREQUENT rows and one for each target
    keys, c = np.array([*common], np.int64).view(np.uint64), np.array([*common.values()], np.int64)
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    frequent = spark.sparkContext.broadcast((keys, c))
    divisor = total + 0.1 * (distinct + 1)
    model = initial(np.append(c, total - c.sum()), others=distinct - len(c))
    whole, last = float(model["whole"]), CLASSES * MEMBERS - 1
    ratios = np.zeros(BINS)
    for turn in range(ROUNDS):
        part = training.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).select("text")
        now = spark.sparkContext.broadcast(model)

        def learnt(batches, now=now, turn=turn):
            trainer, (keys, c), seen = Trainer(now.value, turn), frequent.value, np.zeros(BINS)
            begin = begins(keys)
            m = trainer.m
            base = np.append(np.log(np.maximum(c - 0.9, 0.1) / max(divisor - 1, 0.1)), 0)  # without the token itself
            base[m["target"] == last] = np.log(max(whole - 1, 0.1) / max(divisor - 1, 0.1))  # both parts have the count
            base += m["rest"]
            for batch in batches:
                for block in cut(batch, "text", LARGE):
                    size, hashes = tokens(block)
                    codes = coded(hashes, keys, begin)
                    at = (trainer(codes, size) - base[codes] + LOGS) * (BINS / (2 * LOGS))
                    seen += np.bincount(np.clip(at, 0, BINS - 1).astype(np.int64), minlength=BINS)
            out = [*trainer.slices().to_pylist(), {"slice": -1, "weight": 0.0, "w": seen.tobytes()}] if trainer.seen else []
            yield pa.RecordBatch.from_pylist(out, pa.schema([("slice", pa.int32()), ("weight", pa.float64()), ("w", pa.binary())]))

        model, seen = averaged(model, written(part.mapInArrow(learnt, "slice int, weight double, w binary"), "learnt"))
        ratios += seen
        now.unpersist()
    share = share_of(ratios)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model, (keys, c) = shared.value, frequent.value
        begin = begins(keys)
        base = np.append(np.log(c + 0.1) - np.log(divisor), -np.log(divisor))  # the others get their counts later
        attention = np.zeros(len(base))
        attention[-1] = -model["rest"][-1] - np.log(whole)
        attention += np.log(share)
        for batch in batches:
            for block in cut(batch, "text", LARGE):
                n = block.num_rows
                size, hashes = tokens(block)
                codes, doc = coded(hashes, keys, begin), np.repeat(np.arange(n), size)
                lp, own = code_scores(model, codes, size) + attention[codes], base[codes]
                known = codes < len(keys)
                mixed = np.logaddexp(lp, own + np.log(1 - share))
                rare = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=n))])
                yield pa.RecordBatch.from_pydict({
                    "_id": block.column("_id"), "held": block.column("held"), "n": size.astype(np.int64), "known": np.bincount(doc[known], minlength=n).astype(np.int64),
                    "base": np.bincount(doc, weights=own, minlength=n) / np.log(10), "score": np.bincount(doc, weights=mixed, minlength=n) / np.log(10), "rare": lists(signed(hashes[~known]), rare, pa.int64()),
                })

    kind = rows.schema["_id"].dataType.simpleString()
    first = rows.mapInArrow(run, f"_id {kind}, held boolean, n long, known long, base double, score double, rare array<long>")
    first = written(first.withColumn("rid", F.monotonically_increasing_id()), "scores")
    apart = first.select("rid", F.explode("rare").alias("word")).join(counts, "word", "left")
    apart = apart.groupBy("rid").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rest"))
    out = first.drop("rare").join(apart, "rid", "left")
    rest = F.coalesce("rest", F.lit(0.0))
    return out.select(F.col("_id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") + rest).alias("base_score"), (F.col("score") + rest).alias("score"))
