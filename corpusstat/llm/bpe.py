"""Byte-level BPE encoding and decoding, with a rank queue over a hierarchical bitmap."""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusstat.llm.blocks import cut

#: Pre-tokens and ids that a worker remembers (a block may exceed them), and the characters of the longest pre-token that stays.
MEMO, MEMO_IDS, MEMO_CHARS = 400_000, 3_000_000, 40

#: Ids that are decoded at once, or one row's.
DECODED = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by rank. Three levels of 64-bit words say which ranks have a bucket that isn't empty; find-first-set
    from the top gives the least."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            bucket.append(position)

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its bucket, from left to right; (-1, []) if there is none."""
        if not self.top:
            return -1, []
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Merges of pre-tokens by one vocabulary (ranks of byte strings)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)])
        self.pairs = np.array([ranks.get(bytes([i >> 8, i & 255]), -1) for i in range(1 << 16)])

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token (of a byte or more): in each the leftmost pair of the least rank merges until none has a rank.

        All pre-tokens lie in one row of bytes and share the queue. No pair crosses an edge, so what merges in one
        doesn't change another, and the least rank of all is the least of its own pre-token."""
        if not pieces:
            return []
        ranks, queue, text = self.ranks.get, self.queue, b"".join(pieces)
        push, n, raw = queue.push, len(text), np.frombuffer(text, np.uint8).astype(np.int64)
        firsts = np.cumsum([0, *map(len, pieces)])
        edge = np.zeros(n + 1, np.uint8)
        edge[firsts] = 1
        first = np.full(n, -1)
        first[:-1] = np.where(edge[1:-1] == 1, -1, self.pairs[raw[:-1] << 8 | raw[1:]])
        edge, pair, part = edge.tobytes(), first.tolist(), self.bytes[raw].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n  # linked list of parts by their first byte
        order = np.argsort(first, kind="stable")[np.count_nonzero(first < 0) :]
        if len(order):
            found, starts = np.unique(first[order], return_index=True)
            for rank, positions in zip(found.tolist(), np.split(order, starts[1:])):
                queue.put(rank, positions.tolist())
        while True:
            rank, bucket = queue.pop()
            if rank < 0:
                break
            for at, i in enumerate(bucket):
                if pair[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[i] = after[j]
                part[i], pair[i], pair[j], alive[j] = rank, -1, -1, 0
                before[k] = i
                least = rank
                if not edge[k]:
                    r = ranks(text[i : after[k]])
                    if r is not None:
                        pair[i] = r
                        push(r, i)
                        if r < least:
                            least = r
                if not edge[i]:
                    h = before[i]
                    r = ranks(text[h:k])
                    if r is None:
                        pair[h] = -1
                    else:
                        pair[h] = r
                        push(r, h)
                        if r < least:
                            least = r
                if least < rank:  # goes first
                    if at + 1 < len(bucket):
                        queue.put(rank, bucket[at + 1 :])
                    break
        alive = np.frombuffer(alive, np.uint8)
        ends = np.concatenate([[0], np.cumsum(alive, dtype=np.int64)])[firsts].tolist()
        ids = np.array(part)[alive == 1].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


def encode_piece(piece: bytes, encoder: Encoder) -> list[int]:
    """Ids of one pre-token."""
    whole = encoder.ranks.get(piece)
    return [whole] if whole is not None else encoder.merge([piece])[0]


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and ids (array<int>), of the pre-tokens that pattern matches, without special tokens.

    A null or empty text has no ids; null and repeated ids stay; no rows give no rows; other columns are ignored. The rank file is
    read once and broadcast: it is as large as the vocabulary. A pre-token may be as long as the text: its cost grows with n log n."""
    import regex

    regex.compile(pattern)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        import regex

        ranks, find = shared.value, regex.compile(pattern).findall
        encoder, memo, known, ends = Encoder(ranks), {}, array("i"), array("i", [0])  # the memo's places in known, between two ends
        for batch in batches:
            for block in cut(batch, "text"):
                found = [find(text) if text else [] for text in block.column("text").to_pylist()]
                if len(memo) > MEMO or len(known) > MEMO_IDS:
                    memo, known, ends = {}, array("i"), array("i", [0])
                pieces = list(chain.from_iterable(found))
                new = list(set(pieces).difference(memo))
                raw = [piece.encode() for piece in new]
                ids = list(map(ranks.get, raw))
                split = iter(encoder.merge([b for b, i in zip(raw, ids) if i is None]))
                memo.update(zip(new, range(len(ends) - 1, len(ends) - 1 + len(new))))
                for i in ids:
                    known.extend(next(split) if i is None else (i,))
                    ends.append(len(known))
                at = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
                for piece in new:
                    if len(piece) > MEMO_CHARS:
                        del memo[piece]
                bound = np.array(ends)
                first, size = bound[at], bound[at + 1] - bound[at]
                upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                ids = np.array(known)[np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)]
                rows = upto[np.concatenate([[0], np.cumsum(list(map(len, found)), dtype=np.int64)])]
                yield pa.RecordBatch.from_pydict({"_id": block.column("_id"), "ids": pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("_id", F.array().cast("array<int>").alias("ids")).schema).withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the bytes of their ids in place of ids_col. A null list has no bytes; an id outside the vocabulary fails the job."""
    ranks = sorted((rank, token) for token, rank in read_ranks(path).items())
    ends = np.zeros(ranks[-1][0] + 2, np.int64)
    ends[[rank + 1 for rank, _ in ranks]] = [len(token) for _, token in ranks]
    shared = tokens.sparkSession.sparkContext.broadcast((np.cumsum(ends), b"".join(token for _, token in ranks)))
    schema = tokens.select(*(F.lit(b"").alias(out) if c == ids_col else F.col(c) for c in tokens.columns)).schema
    place = tokens.columns.index(ids_col)

    def run(batches):
        ends, text = shared.value
        text, sizes = np.frombuffer(text, np.uint8), np.diff(ends)
        for batch in batches:
            counts = np.concatenate([[0], np.cumsum(batch.column(place).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(counts, counts[at] + DECODED, "right")) - 1)
                rows = batch.slice(at, to - at)
                ids = rows.column(place).flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                size = sizes[ids]
                upto = np.concatenate([[0], np.cumsum(size)])
                data = text[np.arange(upto[-1]) + np.repeat(ends[ids] - upto[:-1], size)]
                bounds = upto[counts[at : to + 1] - counts[at]].astype(np.int32)
                yield rows.set_column(place, out, pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]))
                at = to

    return tokens.mapInArrow(run, schema)
