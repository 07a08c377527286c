"""Cells that follow the boxes: squares of a page are cut into four while too many boxes have their centre inside."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import CORNERS
from foliospark.session import cut_lineage, stored
from foliospark.skew import same_key

# Boxes with their centre in a cell from which it is cut.
CELL_ROOM = 128
# Columns that name a leaf.
CELL = ("_side", "_gx", "_gy")


def touched(df: DataFrame, side: float, nested: bool = False) -> DataFrame:
    """One row per cell (``_gx``, ``_gy``) of width ``side`` that a box touches; ``nested`` in its present cell of twice the width."""
    for axis in "xy":
        lo, hi = (F.floor(F.col(f"{axis}{n}") / side).cast("long") for n in (1, 2))
        hi = F.greatest(lo, hi)
        if nested:
            parent = F.col(f"_g{axis}") * 2
            lo, hi = F.greatest(lo, parent), F.least(hi, parent + 1)
        df = df.withColumn(f"_g{axis}", F.explode(F.sequence(lo, hi)))
    return df


def in_cell(axis: str, at: Column) -> Column:
    return F.floor(at / F.col("_side")).cast("long") == F.col(f"_g{axis}")


def quad_cells(df: DataFrame, by: Sequence[str], *, room: int = CELL_ROOM, finest: float = 1) -> DataFrame:
    """``df`` (corner columns) once per leaf that a box touches: ``_side``, ``_gx``, ``_gy``.

    A cell is cut while more than ``room`` boxes have their centre in it and its quarters are at least ``finest`` wide
    and not narrower than its boxes are on average, so cutting never copies boxes without parting them.  Every point of a
    page lies in one leaf.  Only crowded cells go on to the next round; there are as many rounds as the tree is deep.
    Boxes with a null corner are in no cell.
    """
    df = stored(df.where(" and ".join(f"{c} is not null" for c in CORNERS)))
    reach = df.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in CORNERS]))).first()[0]
    side = 2.0 ** math.ceil(math.log2(reach + 1)) if reach is not None else 1.0
    at = [*by, "_gx", "_gy"]
    long_side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    current, leaves = touched(df, side).withColumn("_side", F.lit(side)), []
    while True:
        centred = F.lit(True)
        for a in "xy":
            centred &= in_cell(a, (F.col(f"{a}1") + F.col(f"{a}2")) / 2)
        counted = current.groupBy(*at).agg(F.count_if(centred).alias("_n"), F.avg(F.when(centred, long_side)).alias("_long"))
        crowded = cut_lineage(counted.where((F.col("_n") > room) & (F.greatest("_long", F.lit(finest)) <= side / 2)).select(*at))
        if crowded.isEmpty():
            leaves.append(current)
            break
        crowded = crowded.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(at)])
        cond = same_key(current, at, crowded, crowded.columns)
        # One join tells leaves from cells to cut.
        told = stored(current.join(crowded.withColumn("_cut", F.lit(True)), cond, "left").drop(*crowded.columns))
        leaves.append(told.where("_cut is null").drop("_cut"))
        side /= 2
        current = touched(told.where("_cut").drop("_cut"), side, nested=True).withColumn("_side", F.lit(side))
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out
