"""Packing along a space-filling curve.

Each document's words are hashed into a vector of HASH_DIMS counts, which a fixed
matrix projects to DIMS coordinates; these are squashed to a grid of 2^BITS cells
a side and numbered along a Hilbert curve. Tokenised documents are range-sorted by
that number, and each range is one stream that is cut every `size` tokens:
neighbours on the curve share sequences, and only a range's last sequence is
padded.

The tokenised rows are written once before the sort, so texts are tokenised once
though range partitioning samples its input. The sort key ends with hash and
id, so copies, which share a place on the curve, are dealt to many ranges.

Cases: null text is empty and has the end id only; a document longer than a
sequence is cut, and a very long text is tokenised in portions; repeated rows are packed each; null ids are carried; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_steps, staged
from .words import Words, encode_blank_free, library, long_text, portions, strings

HASH_DIMS, DIMS, BITS = 256, 3, 10
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve long, ids binary"
_PIECES = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "curve")] + [("ids", pa.binary())])
_TOKENS = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates in [0, 2^bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level, from the coarsest
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code over the coordinates
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@lru_cache
def _directions() -> np.ndarray:
    """The fixed projection of HASH_DIMS counts to DIMS coordinates."""
    return np.random.default_rng(20).standard_normal((HASH_DIMS, DIMS))


def word_sums(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The projected hashed word counts of each text, and its number of words; both add up over portions of a text."""
    import pandas as pd

    bins = (pd.util.hash_array(np.array(strings(words.distinct), object), categorize=False) % HASH_DIMS).astype(np.int64) if len(words.distinct) else np.zeros(0, np.int64)
    rows = _directions()[bins]
    return np.stack([np.bincount(words.owners, rows[:, k][words.codes], words.n) for k in range(DIMS)], 1), np.bincount(words.owners, minlength=words.n)


def curve_places(sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Places on the curve of sums that are scaled to unit variance for unrelated words."""
    scaled = sums / np.sqrt(np.maximum(n_words, 1))[:, None]
    cells = ((0.5 + np.arctan(scaled) / np.pi) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _read(texts: pa.StringArray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, how many each has, and its word sums."""
    if (text := long_text(texts)) is not None:
        flat, counts, sums, n = zip(*(_read(pa.array([x]), path) for x in portions(text)), strict=True)
        return np.concatenate(flat), sum(counts), sum(sums), sum(n)
    words = Words(texts)
    return *encode_blank_free(words, library(path, spaced=False)), *word_sums(words)


def _tokenised(path: str, end_id: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts, sums, n_words = _read(batch.column("text"), path)
        small = np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.uint32
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]), end_id, small)
        out[np.delete(np.arange(len(out)), ends - 1)] = flat
        data, width = out.tobytes(), out.itemsize
        bounds = np.r_[0, ends] * width
        ids = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(curve_places(sums, n_words)), pa.array(counts + 1), pa.array(ids, pa.binary())], schema=_TOKENS)

    return in_steps("text", work)


def _packed(size: int):
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        filled = 0  # tokens of this range so far
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("doc_id", "curve", "n")}
            rows, held = [], 0
            for doc, curve, n, ids in zip(*cols.values(), batch.column("ids"), strict=True):
                raw = ids.as_buffer()
                values = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    offset = filled % size
                    length = min(size - offset, n - start)
                    rows.append((doc, start, length, n, first + filled // size, offset, curve, values[start : start + length].tobytes()))
                    start, filled, held = start + length, filled + length, held + length
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, curve, n, ids): ids with the end id, 16 bits each where they fit. The tokenizer must drop white space and lower-case; others are refused."""
    return docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer, end_id), "doc_id long, curve long, n long, ids binary")


def pack_along_curve(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence; ids are little-endian unsigned 32-bit."""
    rows = staged(tokenised(docs, tokenizer, end_id), "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("doc_id", "n", F.monotonically_increasing_id())  # rows alike in all columns are dealt to many ranges too
    ranged = rows.withColumn("spread", spread).repartitionByRange(parts, "curve", "spread").sortWithinPartitions("curve", "spread", "doc_id")
    return ranged.select("doc_id", "curve", "n", "ids").mapInArrow(_packed(size), PIECES)
