"""Quality rules: counts of a text's words, symbols and repeats, and bands of zstandard ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusstat.llm.blocks import SPACE, buffers, counts_of, cut, mapped, mix, word_hashes, window_hashes, words

#: (bytes from, least, most) compressed bytes per byte of a whole document; the last row that the length reaches holds. The least ratios lie
#: below nearly all licence and documentation files in English (medians 0.69, 0.58, 0.40, 0.32 and 0.21 from 200 bytes on) and above text
#: that says the same again and again (0.005 to 0.2); what repeats in parts is left to the chunks and to n_repeat_words.
BANDS = ((0, 0.0, 9.0), (64, 0.40, 1.3), (200, 0.35, 0.95), (500, 0.27, 0.85), (2000, 0.22, 0.75), (10000, 0.15, 0.70), (50000, 0.12, 0.70))
#: The same for each chunk of CHUNK bytes of documents longer than one chunk, and how many chunks may be outside. A last piece of
#: less than half a chunk belongs to the chunk before it.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 8192, (0.06, 0.80), 0.34
LEVEL = 3

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTERS = " \t\n\x0b\x0c\r"


def verdicts(data: np.ndarray, offsets: np.ndarray, bands=BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of each whole document, share of its chunks outside the band, and whether it passes."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    n = len(offsets) - 1
    ratio, outside, passes = np.ones(n), np.zeros(n), np.ones(n, bool)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        size = b - a
        if not size:
            continue
        ratio[i] = len(packer.compress(raw[a:b])) / size
        low, high = next((lo, hi) for least, lo, hi in reversed(bands) if size >= least)
        passes[i] = low <= ratio[i] <= high
        if size > CHUNK:
            edges = [*range(a, b - CHUNK // 2 + 1, CHUNK), b]
            parts = [len(packer.compress(raw[i:j])) / (j - i) for i, j in zip(edges, edges[1:])]
            outside[i] = sum(not CHUNK_BAND[0] <= p <= CHUNK_BAND[1] for p in parts) / len(parts)
            passes[i] &= outside[i] <= CHUNK_SHARE
    return ratio, outside, passes


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(LETTERS)] if "\n" in text else ()
    return len(lines) - len(set(lines)) if lines else 0


def base(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words and of words in repeated 5-word windows of each text, and whether the base rules fail it."""
    data, offsets = buffers(block.column("text"))
    n = block.num_rows
    starts, ends, doc = words(data, offsets)
    n_words = counts_of(doc, n)
    windows = window_hashes(word_hashes(data, starts, ends), 5)
    whole = np.flatnonzero(doc[: len(windows)] == doc[len(doc) - len(windows) :])
    _, place, found = np.unique(windows[whole] ^ mix(doc[whole].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    twice = whole[found[place] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    n_repeat = counts_of(doc[np.cumsum(cover[:-1]) > 0], n)
    return n_words, n_repeat, (n_words < 10) | (100 * n_repeat > 20 * n_words)


def counted(block: pa.RecordBatch, bands=BANDS) -> pa.RecordBatch:
    data, offsets = buffers(block.column("text"))
    chars = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    n_words, n_repeat, failed = base(block)
    ratio, outside, passes = verdicts(data, offsets, bands)
    lines = pa.array([dup_lines(x) if x else 0 for x in block.column("text").to_pylist()], pa.int64())
    return pa.RecordBatch.from_pydict({
        "doc_id": block.column("doc_id"), "n_words": n_words, "word_chars": np.diff(chars[offsets]).astype(np.int64), "n_symbols": np.diff(symbols[offsets]).astype(np.int64),
        "n_dup_lines": lines, "n_repeat_words": n_repeat, "base_failed": failed, "kept": passes & ~failed, "ratio": ratio, "bad_chunks": outside,
    })


def good(texts: pa.Array, bands=BANDS) -> pa.Array:
    """Which texts judge() keeps."""
    parts = []
    for block in cut(pa.RecordBatch.from_pydict({"text": texts}), "text"):
        passes = verdicts(*buffers(block.column("text")), bands)[2]
        parts.append(passes & ~base(block)[2])
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    r"""One row per document: its counts, compression ratios and verdict.

    Words are runs without white space (\x20, \x09-\x0D). base_failed: fewer than 10 words, or over
    20 % of the words in 5-word windows that the text holds twice. kept: not base_failed, the whole
    document's zstandard ratio within the band of its length, and at most CHUNK_SHARE of its chunks
    outside CHUNK_BAND. A null or empty text has no words and fails; its ratio is 1. Texts of any length are judged whole. Rows are
    judged one by one, so nulls, ties and repeats in id_col stay; other columns are ignored; no rows give no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, lambda block: counted(block, bands), SCHEMA)


def keep_good(docs: DataFrame, *, text_col: str = "text", bands=BANDS) -> DataFrame:
    """The rows of docs, unchanged, that judge() keeps. Null and empty texts go, repeated rows are judged one by one and stay or go together, no rows
    give no rows, and columns may have any name: only the text is read, and only a verdict comes back from Python."""
    kept = F.arrow_udf(lambda texts: good(texts, bands), "boolean")
    return docs.where(kept(F.col(f"`{text_col}`").cast("string")))
