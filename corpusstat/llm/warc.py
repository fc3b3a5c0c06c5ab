"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page id. The ranges come from histograms of bytes over the ids, refined where a range has too many, so they depend on the
data alone. Each task writes one range: it rolls its files by compressed size, gives each the name of shard and number, writes
under a temporary name and renames when the file is whole. A repeated task writes the same bytes under the same names, and a
reader takes only the files that the manifest lists, which Spark's own commit writes last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least payload, in bytes, of which copies become revisits.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(folder: str):
    """pyarrow's file system of a qualified folder and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it: where Spark puts the manifest, tasks put the files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record; its headers and digests come from the payload. X-Page-Id and X-Refers-To-Page-Id carry the ids."""
    digest = sha1(payload)
    name = lambda i, d: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i} {d}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id, digest)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url))] if url else []
    head += [("X-Page-Id", page_id)] if page_id is not None else []
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)] if revisit else []
    head += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.folder = filesystem(folder)
        self.shard, self.roll, self.k, self.out, self.done = shard, roll, 0, None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.k:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.hash = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member for each record, without a time
        packed = packer.compress(raw) + packer.flush()
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)
        self.n += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        final = f"{self.folder}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # stores that don't rename over a file: an earlier try of this task wrote the same bytes
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        self.done.append((self.shard, self.name, self.n, self.size, self.hash.hexdigest()))
        self.k += 1


def ranges(rows: DataFrame, shard_bytes: int) -> list[tuple[int, int, int]]:
    """(first id, last id, shards) of ranges that cover all ids in order, each of at most shard_bytes, or of one id that has more and gets several shards.

    The span of the ids is cut into equal steps, some for each shard; ranges with too many bytes are cut again, between their own least and greatest id,
    until none is left that can be cut. So one distant id, or ids from end to end of their type, cost another round, and neighbouring small steps join. The
    result depends on the data alone. The driver holds some rows a shard, so shards should be larger where there would be over a million."""
    whole = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    todo, done = [tuple(whole)] if whole[0] is not None else [], []
    while todo:
        wide = sorted(r for r in todo if r[2] > shard_bytes and r[0] < r[1])
        done += [r for r in todo if not (r[2] > shard_bytes and r[0] < r[1])]
        if not wide:
            break
        lows, highs = np.array([r[0] for r in wide], np.int64), np.array([r[1] for r in wide], np.int64)
        steps = [max(1, -(-(b - a + 1) // min(4096, max(16, 4 * n // shard_bytes)))) for a, b, n in wide]
        widths = np.array(steps, np.uint64)

        @F.arrow_udf("struct<k: int, p: int>")
        def place(ids: pa.Array) -> pa.Array:
            key = ids.to_numpy(zero_copy_only=False)
            k = np.searchsorted(lows, key, "right") - 1
            inside = (k >= 0) & (key <= highs[np.maximum(k, 0)])
            k = np.maximum(k, 0)
            p = ((key.view(np.uint64) - lows[k].view(np.uint64)) // widths[k]).astype(np.int32)  # differences modulo 2**64 are right
            return pa.StructArray.from_arrays([pa.array(np.where(inside, k, -1).astype(np.int32)), pa.array(np.where(inside, p, 0).astype(np.int32))], ["k", "p"])

        cells = rows.withColumn("_at", place("page_id")).groupBy("_at").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.sum("bytes").alias("n"))
        todo = [(r.a, r.b, r.n) for r in cells.where("_at.k >= 0").collect()]  # some a shard
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(done):
        if out and out[-1][2] + n <= shard_bytes:
            out[-1] = (out[-1][0], b, out[-1][2] + n)
        else:
            out.append((a, b, n))
    return [(a, b, max(1, -(-n // shard_bytes)) if a == b else 1) for a, b, n in out]


def shards(rows: DataFrame, shard_bytes: int):
    """The function that gives each (page id, number) its shard, the number of shards, and of how many shards an id's records are: records of one id that are
    too many for a shard are dealt out by their number. A null id is before all others."""
    nulls = rows.where("page_id is null").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    spans = ranges(rows.where("page_id is not null"), shard_bytes)
    first = max(1, -(-nulls // shard_bytes)) if nulls else 0
    starts = np.array([a for a, _, _ in spans], np.int64)
    sizes = np.array([n for _, _, n in spans], np.int64)
    before = first + np.cumsum(sizes) - sizes

    @F.arrow_udf("struct<shard: int, n: int>")
    def of(ids: pa.Array, numbers: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        key, number = ids.fill_null(0).to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)
        at = np.maximum(np.searchsorted(starts, key, "right") - 1, 0) if len(starts) else np.zeros(len(key), np.int64)
        n = np.where(known, sizes[at], first) if len(starts) else np.full(len(key), first)
        low = np.where(known, before[at], 0) if len(starts) else np.zeros(len(key), np.int64)
        n = np.maximum(n, 1)
        return pa.StructArray.from_arrays([pa.array((low + number % n).astype(np.int32)), pa.array(n.astype(np.int32))], ["shard", "n"])

    return of, max(1, first + int(sizes.sum()))


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages as WARC files into folder (which all executors reach) and returns the manifest: shard, file, records, bytes, sha256.

    Of records with equal payloads of at least LEAST bytes, that with the largest id is a response and the others revisit it. Nulls: a
    null payload is empty, a null url gives no target, a null id stands first (and revisits a copy that has one). Rows that repeat both id and payload
    are written each, of the same kind. No rows give an empty manifest; other columns are ignored."""
    from corpusstat.llm.blocks import written

    folder = qualified(pages.sparkSession, folder)
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    light = written(rows.select("page_id", F.octet_length("payload").alias("bytes"), F.when(F.octet_length("payload") >= LEAST, F.unhex(F.sha1("payload"))).alias("digest")), "warc-digests")
    of, n = shards(light, shard_bytes)
    several = light.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").drop("n")
    marks = light.join(written(several, "warc-copies"), "digest").where("page_id is null or page_id < last")
    spread = of(F.col("page_id"), F.lit(0).cast("long"))
    marks = marks.distinct().withColumn("_of", spread).withColumn("shard", F.explode(F.sequence(F.col("_of.shard"), F.col("_of.shard") + F.col("_of.n") - 1)))  # to each shard that has records of the id
    marks = marks.select("shard", "page_id", F.lit(0).alias("kind"), "digest", F.col("last").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    number = F.xxhash64("url", F.sha1("payload"), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 31) - 1))  # copies of one record are dealt out too
    bodies = rows.withColumn("_of", of(F.col("page_id"), number)).select(F.col("_of.shard").alias("shard"), "page_id", F.lit(1).alias("kind"), F.unhex(F.sha1("payload")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    laid = marks.union(bodies).repartitionById(n, F.col("shard")).sortWithinPartitions("page_id", "kind", "digest", "url")

    def run(batches):
        roller, marked, of = None, {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if roller is None:
                    roller = Roller(folder, row["shard"], roll_bytes)
                if row["page_id"] != of:
                    marked, of = {}, row["page_id"]
                if not row["kind"]:
                    marked[row["digest"]] = row["refers_to"]
                    continue
                to = marked.get(row["digest"])
                roller.add(record(row["page_id"], row["url"], row["payload"] or b"", to, to is not None))
        if roller:
            roller.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha256"), x)) for x in roller.done], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = laid.mapInArrow(run, "shard int, file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def parsed(stream):
    """(headers, block) of each record of an unpacked WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends too early")
        yield head, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files in the folder's manifest: page_id, record_type, url, payload (null for a revisit), payload_bytes,
    payload_digest (lower-case hex SHA-1 of the full payload) and refers_to. A block or payload that doesn't fit its digest fails the job."""
    folder = qualified(spark, folder)
    files = spark.read.parquet(f"{folder}/manifest").select("file")

    def run(batches):
        fs, at = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parsed(stream):
                        http, _, body = block.partition(b"\r\n\r\n")
                        kind, digest = head["warc-type"], head["warc-payload-digest"]
                        if sha1(block) != head["warc-block-digest"] or kind == "response" and sha1(body) != digest:
                            raise ValueError(f"{name}: a digest doesn't fit")
                        length = int(http.rpartition(b"Content-Length:")[2])
                        rows.append((whole(head.get("x-page-id")), kind, head.get("warc-target-uri"), body if kind == "response" else None, length, base64.b32decode(digest[5:]).hex(), whole(head.get("x-refers-to-page-id"))))
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.repartition(max(1, files.count())).mapInArrow(run, "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")
