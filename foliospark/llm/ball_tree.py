"""Exact top-k inner products: branch and bound over a ball tree of every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.session import cut_lineage

# Rows of a shard and of a block of queries that meet in one task, leaf size, and candidates that give the first bounds.
SHARD_ROWS, BLOCK_ROWS, LEAF, SEED_ROWS = 16_384, 2_048, 64, 2_048


class BallTree:
    """Nested balls (centre, radius) around the rows of a matrix; children halve the widest direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.centre, self.radius, self.children, self.rows = [], [], [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            own = vectors[rows]
            centre = own.mean(axis=0)
            distance = np.sqrt(((own - centre) ** 2).sum(axis=1))
            k = len(self.centre)
            self.centre.append(centre)
            self.radius.append(distance.max())
            self.children.append([-1, -1])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent][side] = k
            if len(rows) > LEAF:
                far = own[distance.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                along = own @ (far - other)
                half = np.argpartition(along, len(rows) // 2)
                todo += [(rows[half[: len(rows) // 2]], k, 0), (rows[half[len(rows) // 2 :]], k, 1)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.scale = np.sqrt((self.centre**2).sum(axis=1)) + self.radius

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """(score, id) of at most k best rows with a score of at least ``floor``, the query's own id left out; ties to smaller ids.

        Nodes are visited by their upper bound q.c + |q| r, and left as soon as it is below the kth score found so far.
        """
        length = float(np.sqrt(query @ query))
        # The bounds are rounded sums, so they get a little room; the scores themselves are exact integers.
        bounds = self.centre @ query + length * self.radius + 1e-9 * length * self.scale + 1e-6
        heap, best = [(-bounds[0], 0)], []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            for i in np.flatnonzero(scores >= floor).tolist():
                own = int(self.ids[rows[i]])
                if own != query_id:
                    entry = (float(scores[i]), -own)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    else:
                        heapq.heappushpop(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(score, -minus) for score, minus in best]


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or has null or non-finite components."""
    column = F.col(vector) if isinstance(vector, str) else vector
    fine = F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(fine, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(k: int):
    """One shard against one block of queries."""

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if queries.num_rows and shard.num_rows:
            tree = BallTree(shard["vec_id"].to_numpy(), _matrix(shard["vector"]))
            for own, query, floor in zip(queries["vec_id"].to_pylist(), _matrix(queries["vector"]), queries["floor"].to_pylist()):
                found += [(own, other, int(score)) for score, other in tree.search(own, query, k, -np.inf if floor is None else floor)]
        columns = list(zip(*found)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


def _floors(seeds, k: int):
    """Adds the kth score among the seeds: a bound that the true kth score cannot be below, known to every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = seeds.value
        for batch in batches:
            floors = []
            for own, row in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
                query = row.values.to_numpy(zero_copy_only=False)
                near = vectors.get(len(query))
                scores = near @ query if near is not None else np.empty(0)
                scores = scores[ids[len(query)] != own] if near is not None else scores
                floors.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64())], names=[*batch.schema.names, "floor"])

    return run


def _split(df: DataFrame, rows: int, name: str, count: int) -> DataFrame:
    return df.withColumn(name, F.expr(f"cast(pmod(xxhash64(vec_id), {max(1, -(-count // rows))}) as int)"))


def top_inner_products(vectors: DataFrame, queries: DataFrame, *, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows.

    Both inputs hold vec_id and vector (array of whole doubles, see :func:`quantised`); null vectors and null ids take no part,
    and only vectors of the same length meet.  Ties go to the smaller vec_id; rows that repeat an id count once each, and
    repeated queries are one.  Fewer than k candidates give fewer rows, no candidates give none.  Scores are exact below 2^53.

    Candidates are cut into shards and queries into blocks of bounded size; each pair of a shard and a block is one task,
    so queries are copied once for each shard and candidates once for each block.  A bounded set of seeds gives every query
    a first lower bound of its kth score, which all shards share; a shard returns nothing below it.
    """
    spark = vectors.sparkSession
    usable = "vec_id is not null and vector is not null and size(vector) > 0"
    vectors = cut_lineage(vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "vector"))
    queries = cut_lineage(queries.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "vector").dropDuplicates(["vec_id"]))
    rows, asked = vectors.count(), queries.count()
    by_length: dict[int, list] = {}
    for row in vectors.limit(SEED_ROWS).collect():
        by_length.setdefault(len(row.vector), []).append(row)
    seeds = spark.sparkContext.broadcast(({n: np.array([r.vec_id for r in found]) for n, found in by_length.items()}, {n: np.array([r.vector for r in found]) for n, found in by_length.items()}))
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asked // block_rows))
    schema = T.StructType([*queries.schema.fields, T.StructField("floor", T.DoubleType())])
    bounded = queries.mapInArrow(_floors(seeds, k), schema).withColumn("length", F.size("vector"))
    left = _split(bounded, block_rows, "block", asked).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = _split(vectors, shard_rows, "shard", rows).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("length", F.size("vector"))
    keys = ("length", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
