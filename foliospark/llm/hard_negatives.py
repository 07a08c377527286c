"""Hard negatives: high-scoring rows of other labels, found by bounds from segment summaries before exact scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import cut_lineage

# Rows of a shard and of a block of anchors that meet in one task, and the largest number of segments a vector is summarised by.
SHARD_ROWS, BLOCK_ROWS, MOST_SEGMENTS = 16_384, 2_048, 16


class Summaries:
    """Mean and deviation of every segment of every row, for 1, 2, 4, ... segments.

    Inside a segment of n components with means x, y and deviations (lengths of what is left of the mean) s, t the inner product
    lies within n x y - s t and n x y + s t; over all segments the bounds add.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.levels = []
        length = vectors.shape[1]
        segments = 1
        while segments <= min(MOST_SEGMENTS, max(1, length // 2)):
            cuts = np.linspace(0, length, segments + 1).astype(int)
            sizes = np.diff(cuts)
            means = np.add.reduceat(vectors, cuts[:-1], axis=1) / sizes
            rest = vectors - np.repeat(means, sizes, axis=1)
            self.levels.append((sizes, means, np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1))))
            segments *= 2
        self.room = 1e-9 * np.sqrt((vectors * vectors).sum(axis=1))

    def refine(self, other: "Summaries", k: int, keep) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the rows that ``keep(rows, lower, upper)`` leaves at every level, for row ``k`` of ``other``."""
        query = other.vectors[k]
        room = self.room * np.sqrt(query @ query) + 1e-6
        rows = np.arange(len(self.vectors))
        for (sizes, means, deviations), (_, own_means, own_deviations) in zip(self.levels, other.levels):
            middle = means[rows] @ (sizes * own_means[k])
            width = deviations[rows] @ own_deviations[k] + room[rows]
            left = keep(rows, middle - width, middle + width)
            if len(left) == 0:
                return rows[:0], np.empty(0)
            rows = rows[left]
        return rows, self.vectors[rows] @ query


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _rows(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def _positives(k: int):
    """The best rows of one shard of a label for each anchor of that label in one block."""

    def run(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if anchors.num_rows and shard.num_rows:
            (ids,), stored, asked = _rows(shard, "vec_id"), Summaries(_matrix(shard["vector"])), Summaries(_matrix(anchors["vector"]))
            for i, anchor in enumerate(anchors["vec_id"].to_pylist()):

                def keep(rows, lower, upper):
                    other = ids[rows] != anchor
                    if other.sum() <= k:
                        return np.flatnonzero(other)
                    # What k rows certainly reach is a floor for all.
                    floor = np.partition(lower[other], other.sum() - k)[other.sum() - k]
                    return np.flatnonzero(other & (upper >= floor))

                rows, scores = stored.refine(asked, i, keep)
                found += [(anchor, int(ids[rows[j]]), int(scores[j])) for j in _best(ids[rows], scores, k)]
        return _table(found, _POSITIVE)

    return run


def _negatives(k: int, low: int, high: int):
    """The best rows of other labels in one shard, for each anchor and positive of one block, inside the positive's score range."""

    def run(anchors: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if anchors.num_rows and shard.num_rows:
            (ids, labels), stored, asked = _rows(shard, "vec_id", "label"), Summaries(_matrix(shard["vector"])), Summaries(_matrix(anchors["vector"]))
            for i, (anchor, label, positives) in enumerate(zip(*(anchors[c].to_pylist() for c in ("vec_id", "label", "positives")))):
                # low * positive <= 100 * negative <= high * positive in whole numbers.
                ranges = [(p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                ranges = [r for r in ranges if r[2] <= r[3]]
                if not ranges:
                    continue

                def keep(rows, lower, upper):
                    wanted = np.zeros(len(rows), bool)
                    other = labels[rows] != label
                    for _, _, least, most in ranges:
                        # Rows certain to lie inside the range set a floor for all rows of it.
                        inside = lower[other & (lower >= least) & (upper <= most)]
                        floor = max(least, np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else least
                        wanted |= other & (upper >= floor) & (lower <= most)
                    return np.flatnonzero(wanted)

                rows, scores = stored.refine(asked, i, keep)
                for positive, score, least, most in ranges:
                    fit = np.flatnonzero((scores >= least) & (scores <= most))
                    best = fit[_best(ids[rows[fit]], scores[fit], k)]
                    found += [(anchor, positive, score, int(ids[rows[j]]), int(scores[j])) for j in best]
        return _table(found, _NEGATIVE)

    return run


def _split(df: DataFrame, name: str, parts: int) -> DataFrame:
    return df.withColumn(name, F.expr(f"cast(pmod(xxhash64(vec_id), {parts}) as int)"))


def _meet(anchors: DataFrame, rows: DataFrame, keys: tuple[str, ...], blocks: int, shards: int, search, schema: pa.Schema) -> DataFrame:
    """Every block of anchors with every shard of rows, each pair in a task of its own."""
    left = _split(anchors, "block", blocks).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("length", F.size("vector"))
    right = _split(rows, "shard", shards).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("length", F.size("vector"))
    by = (*keys, "length", "shard", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, ", ".join(f"{f.name} long" for f in schema))


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    *,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives``
    best other rows of the same label, the best ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, counted by ``rank`` from 1.

    Both inputs hold vec_id, label and vector (array of whole doubles, see ``ball_tree.quantised``); scores are inner products,
    exact below 2^53; ties go to the smaller id.  Rows with a null id, label or vector, or an empty vector take no part, and only
    vectors of the same length meet.  Equal rows count once; rows that repeat an id with other contents are one row, the one with
    the smallest label and vector.  Fewer candidates give fewer rows, none give none.  Other columns are left out.

    Every vector is summarised by mean and deviation of its segments; products of means plus or minus products of deviations
    bound a score.  Rows whose bounds cannot reach the range or the kth best are left out at one segment, the others at two, four
    and so on, and what is left is scored exactly.  Rows are cut into shards (positives: inside their label) and anchors
    into blocks of bounded size; each pair of them is one group, so a frequent label is many groups.  Each group returns at most
    its own best rows, which a ranking over anchors and positives then merges.
    """

    def usable(df: DataFrame) -> DataFrame:
        found = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
        found = found.where("vec_id is not null and label is not null and vector is not null and size(vector) > 0")
        one = found.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
        return cut_lineage(one.select("vec_id", "row.label", "row.vector"))

    rows, asked = usable(vectors), usable(anchors)
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_rows))

    def first(df: DataFrame, by: list[str], score: str, own: str, k: int) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(score), own)
        return df.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")

    near = _meet(asked, rows, ("label",), blocks, shards, _positives(positives), _POSITIVE)
    near = first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    # At most ``positives`` entries for each anchor.
    wanted = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    ready = asked.join(wanted, asked["vec_id"] == wanted["anchor_id"]).drop("anchor_id")
    found = _meet(ready, rows, (), blocks, shards, _negatives(negatives, low, high), _NEGATIVE)
    best = first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
