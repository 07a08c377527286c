"""Tiled detection: window planning, moving tile boxes to page coordinates, joining tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_origins(length: Column, tile: int, stride: int) -> Column:
    """Window origins along one axis: every stride, plus one flush with the far edge."""
    flush = F.greatest(F.lit(0), length - tile)
    steps = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(stride))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(steps, F.array(flush))))


def plan_tiles(pages: DataFrame, *, tile: int = 640, overlap: float = 0.2, page: str = "page_id") -> DataFrame:
    """Overlapping windows of every page, row by row, clipped to the page: ``tile_no, tx1, ty1, tx2, ty2``."""
    stride = max(1, int(tile * (1.0 - overlap)))
    w, h = F.col("w").cast("int"), F.col("h").cast("int")
    xs, ys = tile_origins(w, tile, stride), tile_origins(h, tile, stride)
    rows = pages.select(page, w.alias("_w"), h.alias("_h"), xs.alias("_xs"), F.posexplode(ys).alias("_row", "ty1"))
    cells = rows.select(page, "_w", "_h", "_row", "ty1", F.size("_xs").alias("_n"), F.posexplode("_xs").alias("_col", "tx1"))
    return cells.select(page, (F.col("_row") * F.col("_n") + F.col("_col")).alias("tile_no"), "tx1", "ty1",
                        F.least(F.col("tx1") + tile, F.col("_w")).alias("tx2"),
                        F.least(F.col("ty1") + tile, F.col("_h")).alias("ty2"))


def translate_tiles(
    det: DataFrame, pages: DataFrame, *, tile: int = 640, overlap: float = 0.2, page: str = "page_id"
) -> DataFrame:
    """Tile boxes (with ``tile_no``) in page coordinates.

    The origin follows from the page size and the tile number, so the boxes meet one row per page
    instead of the whole tile plan.
    """
    stride = max(1, int(tile * (1.0 - overlap)))
    axes = pages.select(page, tile_origins(F.col("w").cast("int"), tile, stride).alias("_xs"),
                        tile_origins(F.col("h").cast("int"), tile, stride).alias("_ys"))
    row = F.floor(F.col("tile_no") / F.size("_xs")).cast("int")
    placed = det.join(axes, page).withColumns({
        "_x": F.get("_xs", F.col("tile_no") % F.size("_xs")), "_y": F.get("_ys", row)})
    moved = {c: F.col(c) + F.col("_x" if c[0] == "x" else "_y") for c in ("x1", "y1", "x2", "y2")}
    return placed.where("_y IS NOT NULL").withColumns(moved).select(*det.columns)


def union_tiles(*parts: DataFrame) -> DataFrame:
    """All tile results as one table, matched by column name."""
    return reduce(DataFrame.unionByName, parts)
