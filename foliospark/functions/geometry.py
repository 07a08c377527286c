"""Box arithmetic as SQL expressions: no Python per row, usable in joins and inside higher-order functions.

A box is named by the prefix of its corner columns: ``""`` for ``x1…y2``, ``"a_"`` for ``a_x1…``,
``"b."`` for the fields of a struct ``b``.  Text keeps the nested folds cheap to build; the
functions without ``_sql`` give columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def _span(lo: str, hi: str) -> str:
    return f"CAST(greatest({hi} - {lo}, 0) AS DOUBLE)"


def area_sql(b: str = "") -> str:
    return f"({_span(f'{b}x1', f'{b}x2')} * {_span(f'{b}y1', f'{b}y2')})"


def inter_sql(a: str, b: str) -> str:
    width = _span(f"greatest({a}x1, {b}x1)", f"least({a}x2, {b}x2)")
    height = _span(f"greatest({a}y1, {b}y1)", f"least({a}y2, {b}y2)")
    return f"({width} * {height})"


def meet_sql(a: str, b: str) -> str:
    """Interiors intersect: four comparisons, cheap enough to stand before any area arithmetic."""
    return f"({a}x1 < {b}x2 AND {b}x1 < {a}x2 AND {a}y1 < {b}y2 AND {b}y1 < {a}y2)"


def iou_sql(a: str, b: str) -> str:
    inter = inter_sql(a, b)
    return f"try_divide({inter}, {area_sql(a)} + {area_sql(b)} - {inter})"


def smaller_share_sql(a: str, b: str) -> str:
    return f"try_divide({inter_sql(a, b)}, least({area_sql(a)}, {area_sql(b)}))"


def row_overlap_sql(a: str, b: str, share: float) -> str:
    """Vertical overlap larger than ``share`` of the lower height."""
    return (f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1) > "
            f"{share!r}D * least({a}y2 - {a}y1, {b}y2 - {b}y1))")


def box_area(b: str = "") -> Column:
    return F.expr(area_sql(b))


def box_iou(a: str, b: str) -> Column:
    """Intersection over union; 0 when the boxes do not meet."""
    return F.expr(f"CASE WHEN {meet_sql(a, b)} THEN coalesce({iou_sql(a, b)}, 0D) ELSE 0D END")


def box_overlap_min(a: str, b: str) -> Column:
    """Intersection over the smaller area; 0 when the boxes do not meet."""
    return F.expr(f"CASE WHEN {meet_sql(a, b)} THEN coalesce({smaller_share_sql(a, b)}, 0D) ELSE 0D END")


def boxes_meet(a: str, b: str) -> Column:
    return F.expr(meet_sql(a, b))


def half_up(value: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(value + F.lit(0.5))
