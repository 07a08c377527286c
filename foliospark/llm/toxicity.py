"""Toxicity of whole texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import chunks, encode, slices, sum_slices
from foliospark.session import cut_lineage
from foliospark.skew import broadcast_if_small

# Lengths in bytes of the n-grams of lower-cased text whose words stand between single blanks; buckets they are hashed to.
SIZES, BITS = (4, 5, 6), 18
SLICE = 1 << 13
# Labelled rows of each class, at most, on which the linear weights are fitted.  The ratios come from all of them.
SAMPLE_ROWS = 3_000
# Passes over the sample, step, shrinkage, and weight of a toxic row against a clean one.
PASSES, STEP, SHRINK, TOXIC_WEIGHT = 10, 0.3, 1e-3, 4.0
SMALL_ROWS = 200_000


@dataclass
class ToxicityModel:
    """Weight of each bucket, its ratio already multiplied in, and the intercept."""

    weights: np.ndarray
    intercept: float


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of the whole text, repeats included."""
    data = np.frombuffer(encode(f" {' '.join((text or '').lower().split())} "), np.uint8).astype(np.uint64)
    parts, h = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + data[n - 1 :] + np.uint64(1)
        if n in SIZES:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
    return found[first], np.diff(np.append(first, len(found))).astype(np.float64)


def _packed(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps between the buckets of a text and their counts, in the fewest bytes that hold them all."""
    gaps = np.diff(found, prepend=0)
    return gaps.astype(np.min_scalar_type(int(gaps.max()))), counts.astype(np.min_scalar_type(int(counts.max())))


def _unpacked(gaps: np.ndarray, counts: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their values: ratio times count, by the length of the vector of counts)."""
    found, counts = np.cumsum(gaps, dtype=np.int64), counts.astype(np.float64)
    return found, (ratio[found] * counts / np.sqrt((counts * counts).sum())).astype(np.float32)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the n-grams in each text, summed per class: clean in the first half of the vector, toxic in the second."""
    total = np.zeros(2 << BITS)
    for batch, texts in chunks(batches, "text"):
        for toxic, text in zip(batch.column("toxic").to_pylist(), texts):
            found, counts = _counted(grams(text))
            if len(found):
                total[found + (toxic << BITS)] += counts * (1000.0 / counts.sum())
    rows = slices(total, SLICE)
    if rows:
        yield rows


def _fitted(ratio):
    """One row (weights, intercept): logistic regression by adaptive gradient steps, in a fixed order of the rows.

    The rows are held packed, about three bytes for a bucket; their values are computed anew in each pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rows = ratio.value, []
        for batch in batches:
            for doc, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                found, counts = _counted(grams(text))
                if len(found):
                    rows.append((doc, toxic, *_packed(found, counts)))
        rows.sort(key=lambda row: (row[0], row[1], len(row[2])))
        weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
        intercept, intercept_seen = 0.0, 1e-6
        order = np.random.default_rng(7)
        for _ in range(PASSES):
            for i in order.permutation(len(rows)):
                _, toxic, gaps, counts = rows[i]
                found, scaled = _unpacked(gaps, counts, r)
                score = float(weights[found] @ scaled) + intercept
                slope = (1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))) - toxic) * (TOXIC_WEIGHT if toxic else 1.0)
                step = slope * scaled + SHRINK * weights[found]
                seen[found] += step * step
                weights[found] -= STEP * step / np.sqrt(seen[found])
                intercept_seen += slope * slope
                intercept -= STEP * slope / np.sqrt(intercept_seen)
        yield pa.RecordBatch.from_arrays([pa.array([(weights * r).tobytes()], pa.binary()), pa.array([intercept])], names=["weights", "intercept"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that take no part in the training: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Model from the rows of ``labels`` (doc_id, toxic 0/1) that are not held out, and their texts in ``docs``.

    Null labels are ignored; of several labels of a document the highest counts.  The log-count ratios are gathered over all
    labelled rows as vectors of fixed size.  The weights are fitted in one task on at most ``sample_rows`` rows of each
    class, chosen by a hash of the id.  Without rows of both classes every text gets the score 0.5 and no text is toxic.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = broadcast_if_small(known.where(~held_out()), SMALL_ROWS)
    train = docs.select("doc_id", "text").join(known, "doc_id")
    counts = sum_slices(train.mapInArrow(_class_counts, "slice int, at binary, values binary"), 2 << BITS, SLICE)
    clean, toxic = counts[: 1 << BITS], counts[1 << BITS :]
    if not clean.any() or not toxic.any():
        return ToxicityModel(np.zeros(1 << BITS), -1e-9)
    clean, toxic = clean + 0.5, toxic + 0.5
    ratio = spark.sparkContext.broadcast(np.log(toxic / toxic.sum()) - np.log(clean / clean.sum()))
    ids = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    # At most 2 * sample_rows ids of 12 bytes.
    sample = docs.select("doc_id", "text").join(F.broadcast(cut_lineage(ids[0].union(ids[1]))), "doc_id")
    weights, intercept = sample.repartition(1).mapInArrow(_fitted(ratio), "weights binary, intercept double").first()
    return ToxicityModel(np.frombuffer(weights).astype(np.float32), intercept)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on), from the column text alone.

    Null and empty texts are scored by the intercept.  Rows are independent of each other, and columns of docs that have the
    new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (score, predicted)]
    kept = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value.weights, shared.value.intercept
        for batch, texts in chunks(batches, "text"):
            sums = np.full(len(texts), intercept)
            for i, text in enumerate(texts):
                found = grams(text)
                if len(found):
                    _, counts = _counted(found)
                    sums[i] += float(weights[found].sum(dtype=np.float64)) / np.sqrt((counts * counts).sum())
            out = 1.0 / (1.0 + np.exp(-np.clip(sums, -500, 500)))
            columns = [*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, score, predicted])

    schema = kept.withColumns({score: F.lit(0.0), predicted: F.lit(0)}).schema
    return kept.mapInArrow(run, schema)
