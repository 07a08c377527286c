"""Pieces shared by the corpus operators: tables, bitmaps of fixed size, hashing of word runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIER = 0x9E3779B97F4A7C15
_SYMBOLS = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches whose texts have about ``size`` characters together (one text may be longer)."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(ends, size + (ends[first - 1] if first else 0)))
            part = batch.slice(first, last + 1 - first)
            yield part, part.column(column).to_pylist()
            first = last + 1
    # A worker that waits for its next task keeps no buffers.
    pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        found = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = found
    return _powers


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from one running polynomial sum."""
    up, down = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(texts: list, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: ``words`` successive words, or all words of a shorter text.

    Words are what ASCII white space leaves after A-Z has been lower-cased; no word gives an empty array.
    """
    parts = [b" ".join(encode(t).translate(LOWER).split()) for t in texts]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
    counts = np.array([p.count(b" ") + 1 if p else 0 for p in parts])
    # An empty text between two separators looks like one empty word.
    first = np.concatenate([[0], np.cumsum(np.maximum(counts, 1))])
    wide = max(len(starts) - words + 1, 0)
    hashes = hash_ranges(data, starts[:wide], ends[words - 1 :]) if wide else np.empty(0, np.uint64)
    out, none = [], np.empty(0, np.uint64)
    for n, at, part in zip(counts.tolist(), first.tolist(), parts):
        if n == 0:
            out.append(none)
        elif n < words:
            one = np.frombuffer(part, np.uint8)
            out.append(hash_ranges(one, np.array([0]), np.array([len(one)])))
        else:
            out.append(np.unique(hashes[at : at + n - words + 1]))
    return out


def slot(key, bits: int = 24) -> Column:
    """Place of a key in a bitmap of 2^bits bits."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def bitmap(slots: DataFrame, bits: int = 24) -> np.ndarray:
    """Bitmap of a column ``slot``: a membership filter of fixed size, gathered as 64-bit words.

    At most 2^(bits - 6) longs reach the driver, however many keys there are; many keys only make it less selective.
    """
    words = (
        slots.groupBy(F.expr("cast(slot >> 6 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for word, value in words.collect():
        out[word] = value
    return out.view(np.uint64)


def in_bitmap(filled: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.uint64)
    return (filled[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def slices(vector: np.ndarray, width: int) -> pa.RecordBatch | None:
    """The non-zero entries of a vector as rows (slice, at, values); None if there are none."""
    parts = [(k, np.flatnonzero(part), part) for k, part in enumerate(vector.reshape(-1, width))]
    rows = [(k, at.astype(np.uint16).tobytes(), part[at].astype(np.float32).tobytes()) for k, at, part in parts if len(at)]
    if not rows:
        return None
    k, at, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["slice", "at", "values"])


def sum_slices(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """The sum of vectors of a fixed size that tasks have cut with :func:`slices`; width is at most 65,536."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, values in zip(*(c.to_pylist() for c in batch.columns)):
                totals.setdefault(k, np.zeros(width))[np.frombuffer(at, np.uint16)] += np.frombuffer(values, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["slice", "total"])

    out = np.zeros(size)
    parts = rows.select("slice", "at", "values").repartition(size // width, "slice")
    for k, total in parts.mapInArrow(add, "slice int, total binary").collect():
        out[k * width : (k + 1) * width] = np.frombuffer(total)
    return out
