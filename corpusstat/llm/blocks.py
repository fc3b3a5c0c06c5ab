"""Vectorised work on blocks of texts inside Spark's Python workers.

Spark hands a worker Arrow batches. A batch is cut into blocks of bounded bytes
(a single longer text is a block of its own), and words, hashes and windows of a
whole block are computed with numpy on the UTF-8 bytes, never on Python strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text in a block. The arrays made of a block then fit a core's cache, and a worker stays small.
BLOCK = 1 << 18

#: Multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: White space of the contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, and safe if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/corpusstat/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder, by name. Each goes when its name is written again or dropped."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/corpusstat/{job}-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            if name in self.paths:
                path = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(set(self.paths) - set(names)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - int(offsets[0])


def cut(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes in the column, or one row."""
    at, n = 0, batch.num_rows
    if not n:
        return
    ends = buffers(batch.column(column))[1][1:]
    while at < n:
        begun = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begun + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """f over blocks of df. f returns a batch of the schema, or None."""

    def run(batches):
        for batch in batches:
            for block in cut(batch, column):
                if (out := f(block)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data], with a byte or truth value for each byte."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't breaks; no run crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = translated(data, ~breaks)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the spans, and the number of the text that each is in."""
    starts, ends = spans(data, offsets, breaks)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places of a word whose bytes' values are looked up, for all words at once.
PLACES = 64
_values: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], none of them empty: sums of one random value for each byte and place. Unlike
    polynomials modulo 2**64, they have no structured words (such as Thue and Morse's) that collide."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if not _values:
        _values.append(mix(np.arange(PLACES << 8, dtype=np.uint64) + np.uint64(BASE)))
    size = ends - starts
    long = np.minimum(size, PLACES + 1)
    order = np.argsort(-long.astype(np.int8), kind="stable")  # the longest first, so that those with a byte at a place come before all others
    left = len(size) - np.cumsum(np.bincount(long, minlength=PLACES + 2))
    at, sums = starts[order], size[order].astype(np.uint64)
    for place, n in enumerate(left[:PLACES].tolist()):
        if not n:
            break
        at = at[:n]
        sums[:n] += _values[0][place << 8 : (place + 1) << 8].take(data.take(at))
        at += 1
    if n := int(left[PLACES]):
        more = size[order[:n]] - PLACES
        first = np.cumsum(more) - more
        place = np.arange(int(first[-1] + more[-1])) - np.repeat(first, more)
        key = data[place + np.repeat(at[:n], more)] + (place + PLACES << 8)
        sums[:n] += np.add.reduceat(mix(key.astype(np.uint64) + np.uint64(BASE)), first)
    out = np.empty_like(sums)
    out[order] = sums
    return mix(out)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; the longest so far is kept while it is small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * BLOCK), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[start:end]: equal runs have equal hashes, wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts])


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i:i+k] for each i."""
    starts = np.arange(max(0, len(hashes) - k + 1))
    return run_hashes(hashes, starts, starts + k)


def sliding(x: np.ndarray, k: int, op: np.ufunc) -> np.ndarray:
    """op over x[i:i+k] for each i, by doubling."""
    if len(x) < k:
        return x[:0]
    width = 1
    while 2 * width <= k:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


def counts_of(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
