"""Map columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_mean(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Mean per map key over all rows of a group, an absent key counting 0; one row per group and key."""
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    sums = df.select(*by, F.explode(column).alias("key", "_value")).groupBy(*by, "key").agg(F.sum("_value").alias("_sum"))
    return sums.join(rows, list(by)).select(*by, "key", (F.col("_sum") / F.col("_rows")).alias("mean"))


def map_merge(base: Column | str, patch: Column | str) -> Column:
    """Entries of both maps, the patch winning."""
    return F.map_zip_with(base, patch, lambda _, a, b: F.coalesce(b, a))
