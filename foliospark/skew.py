"""Numbering and prefix sums per key that stay balanced when one key owns a large share of the rows.

A window partitioned by a key puts all rows of that key into one task.  Every operator of the
package that ranks or accumulates inside a key goes through :func:`prefix_scan`: keys below
``limit`` rows use the plain window, larger keys are range-partitioned *inside* the key, scanned
slice by slice and shifted by the totals of the slices before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import cut_lineage

# Rows of one key that a single task sorts and scans.
GROUP_LIMIT = 2_000_000
# Hot keys held as literals and broadcast; beyond this count they stay a distributed table.
HOT_KEYS_LITERAL = 1_000


def names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def hot_keys(df: DataFrame, by: Sequence[str], limit: int | None) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None; one map-side combined count over the key columns.

    A limit of None says that the caller has already found, or knows, every key to be small.
    """
    if limit is None:
        return None
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    largest = counts.agg(F.max("_rows")).first()[0]
    if largest is None or largest <= limit:
        return None
    counts = counts.where(F.col("_rows") > limit).select(*[F.col(c).alias(f"_hot{i}") for i, c in enumerate(by)])
    found = counts.take(HOT_KEYS_LITERAL + 1)
    if len(found) > HOT_KEYS_LITERAL:
        return counts
    return F.broadcast(df.sparkSession.createDataFrame(found, counts.schema))


def needed_limit(df: DataFrame, by: str | Sequence[str], limit: int | None) -> int | None:
    """``limit`` when some key exceeds it, else None: one count that spares the steps behind it their own."""
    return None if hot_keys(df, names(by), limit) is None else limit


def same_key(left: DataFrame, by: Sequence[str], right: DataFrame, right_by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(by, right_by):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def split_hot(df: DataFrame, by: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    cond = same_key(df, by, hot, [f"_hot{i}" for i in range(len(by))])
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi")


def _scan(df, keys, order, rank, totals) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = {}
    if rank:
        cols[rank] = F.row_number().over(w).cast("long")
    for name, value in totals.items():
        cols[name] = F.coalesce(F.sum(value).over(before), F.lit(0))
    return df.withColumns(cols)


def prefix_scan(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str | Column],
    *,
    rank: str | None = None,
    totals: Mapping[str, Column] | None = None,
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Add a 1-based ``rank`` and/or exclusive running ``totals`` per key.

    ``order`` should be total inside a key; rows that tie on it are interchangeable.
    """
    by, order, totals = names(by), as_columns(order), dict(totals or {})
    hot = hot_keys(df, by, limit)
    if hot is None:
        return _scan(df, by, order, rank, totals)
    cold, warm = split_hot(df, by, hot)
    return _scan(cold, by, order, rank, totals).unionByName(_sliced_scan(warm, by, order, rank, totals))


def _sliced_scan(df, by, order, rank, totals) -> DataFrame:
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"_v{i}": v for i, v in enumerate(totals.values())})
    # Range bounds are sampled per execution, so both uses below must read one materialised slicing.
    placed = cut_lineage(
        valued.repartitionByRange(slices, *[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id())
    )
    values = {name: F.col(f"_v{i}") for i, name in enumerate(totals)}
    local = _scan(placed, [*by, "_slice"], order, rank, values)

    sums = [F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values.values())]]
    sliced = placed.groupBy(*by, "_slice").agg(*sums)
    # At most one row per key and slice, so this window is bounded by the partition count.
    w = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sliced.select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)],
        F.col("_slice").alias("_bs"),
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).alias(f"_t{i}") for i in range(len(values))],
    )
    cond = same_key(local, by, shift, [f"_b{i}" for i in range(len(by))]) & (local["_slice"] == shift["_bs"])
    out = local.join(shift, cond)
    cols = {}
    if rank:
        cols[rank] = F.col(rank) + F.col("_n0")
    for i, name in enumerate(values):
        cols[name] = F.col(name) + F.col(f"_t{i}")
    added = ([rank] if rank else []) + list(values)
    return out.withColumns(cols).select(*df.columns, *added)


def number_rows(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str | Column],
    name: str,
    *,
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """1-based position of each row inside its key."""
    return prefix_scan(df, by, order, rank=name, limit=limit)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint only when the side is counted to be small; otherwise the planner decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_parts(
    df: DataFrame, by: str | Sequence[str], order: Sequence[str | Column], name: str, *, size: int
) -> DataFrame:
    """Cut keys with more than ``size`` rows into consecutive parts of at most ``size`` rows (others are part 0)."""
    by = names(by)
    hot = hot_keys(df, by, size)
    if hot is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    cold, warm = split_hot(df, by, hot)
    ranked = number_rows(warm, by, order, "_nth_row")
    warm = ranked.withColumn(name, F.floor((F.col("_nth_row") - 1) / size).cast("long")).drop("_nth_row")
    return cold.withColumn(name, F.lit(0).cast("long")).unionByName(warm)
