"""Detections: decoding, filtering, scaling, windows, validation, pairs and merging into panels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.functions.geometry import CORNERS, box_area, box_iou, box_overlap_min, boxes_meet, half_up
from foliospark.operators.asof import codes, near_marks, walk_arrays, whole_keys
from foliospark.operators.order import assign_reading_order, bubble_numbers, nth_free
from foliospark.operators.quadtree import CELL, CELL_ROOM, in_cell, quad_cells
from foliospark.operators.suppress import FOLD_LIMIT, greedy_keep, iou_above
from foliospark.session import cut_lineage, stored
from foliospark.skew import GROUP_LIMIT, HOT_KEYS_LITERAL, hot_keys, names, needed_limit, number_rows, same_key, split_hot

# Bubble types and merge modes.
BUBBLE_TYPES = ("speech", "thought", "sfx", "narration")
MERGE_MODES = ("append", "replace")

# Boxes of one page that are paired without a grid.
PAIR_LIMIT = 1_000


def tensor_layout(raw: Column, num_classes: int = 1) -> Column:
    """``rows`` for N×6, ``single`` for 5×N with one class, ``classes`` for (4+C)×N, else null."""
    height, width = F.size(raw), F.size(F.get(raw, F.lit(0)))
    return (F.when(width == 6, F.lit("rows"))
            .when((height == 5) & F.lit(num_classes <= 1), F.lit("single"))
            .when(height >= 4 + num_classes, F.lit("classes")))


def decode_detections(
    tensors: DataFrame,
    *,
    raw: str = "raw",
    num_classes: int = 1,
    class_id: int = 0,
    conf: float | None = None,
    on_unknown: str = "error",
) -> DataFrame:
    """Raw detector output to one row per candidate: ``det_id``, centre, size, score and corners.

    ``conf`` drops weak candidates inside the array, before rows are made.  A tensor of unknown
    shape fails the job, or is left out with ``on_unknown="drop"`` (see :func:`tensor_layout`).
    """
    t, layout = F.col(raw), tensor_layout(F.col(raw), num_classes)

    def at(row: int | Column, i: Column) -> Column:
        return F.get(F.get(t, F.lit(row) if isinstance(row, int) else row), i).cast("double")

    def candidate(i, cx, cy, w, h, score) -> Column:
        return F.struct(i.cast("int").alias("det_id"), cx.alias("cx"), cy.alias("cy"), w.alias("bw"), h.alias("bh"),
                        score.alias("score"))

    def from_row(r: Column, i: Column) -> Column:
        x1, y1, x2, y2, score = (F.get(r, F.lit(k)).cast("double") for k in range(5))
        return candidate(i, (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, score)

    def from_column(score_row: int):
        return lambda i: candidate(i, at(0, i), at(1, i), at(2, i), at(3, i), at(score_row, i))

    empty = F.size(t) == 0
    wanted = F.filter(t, lambda r: F.get(r, F.lit(5)).cast("int") == class_id)
    count = F.size(F.get(t, F.lit(0)))
    columns = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    items = (F.when(layout == "rows", F.transform(wanted, from_row))
             .when(layout == "single", F.transform(columns, from_column(4)))
             .when(layout == "classes", F.transform(columns, from_column(4 + class_id))))
    if on_unknown == "error":
        message = F.concat(F.lit("unexpected detector output shape "), F.size(t).cast("string"))
        items = items.otherwise(F.when(~empty, F.raise_error(message)))
    if conf is not None:
        items = F.filter(items, lambda d: d.getField("score") > conf)
    rest = [c for c in tensors.columns if c != raw]
    rows = tensors.select(*rest, F.explode_outer(items).alias("_d")).where("_d IS NOT NULL").select(*rest, "_d.*")
    return to_corners(rows)


def to_corners(det: DataFrame) -> DataFrame:
    """Centre and size to corners."""
    return det.withColumns({
        "x1": F.col("cx") - F.col("bw") / 2, "y1": F.col("cy") - F.col("bh") / 2,
        "x2": F.col("cx") + F.col("bw") / 2, "y2": F.col("cy") + F.col("bh") / 2,
    })


def to_centres(det: DataFrame) -> DataFrame:
    """Corners to centre and size."""
    return det.withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2,
        "bw": F.col("x2") - F.col("x1"), "bh": F.col("y2") - F.col("y1"),
    })


def filter_score(det: DataFrame, conf: float = 0.35, *, score: str = "score") -> DataFrame:
    """Strictly above the confidence."""
    return det.where(F.col(score) > conf)


def _sized(det: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    return det.join(pages.select(page, F.col("w").alias("_w"), F.col("h").alias("_h")), page)


def rescale_clip(det: DataFrame, pages: DataFrame, *, input_size: int = 640, page: str = "page_id") -> DataFrame:
    """Model coordinates to page pixels: scaled, truncated toward zero, clipped to the page."""
    def scaled(c: str, size: str) -> Column:
        pixel = (F.col(c) * (F.col(size) / float(input_size))).cast("int")
        return F.greatest(F.lit(0), F.least(pixel, F.col(size)))

    return _sized(det, pages, page).withColumns({
        "x1": scaled("x1", "_w"), "y1": scaled("y1", "_h"), "x2": scaled("x2", "_w"), "y2": scaled("y2", "_h"),
    }).select(*det.columns)


def filter_min_area(det: DataFrame, min_area: int = 32) -> DataFrame:
    """Drop boxes whose non-negative width times height is below ``min_area``."""
    return det.where(box_area() >= min_area)


def normalize_bbox(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Array of four numbers to integer corners: rounded half to even, inverted corners swapped.

    ``valid`` is false, and the corners null, when the array does not have four numbers.
    """
    ok = F.coalesce((F.size(bbox) == 4) & F.forall(bbox, lambda v: v.isNotNull()), F.lit(False))
    v = [F.when(ok, F.bround(F.get(bbox, F.lit(i)).cast("double"), 0).cast("int")) for i in range(4)]
    return df.withColumns({
        "x1": F.least(v[0], v[2]), "y1": F.least(v[1], v[3]),
        "x2": F.greatest(v[0], v[2]), "y2": F.greatest(v[1], v[3]), "valid": ok,
    })


def padded_window(det: DataFrame, pages: DataFrame, *, padding: int = 12, page: str = "page_id") -> DataFrame:
    """Crop window grown by ``padding`` inside the page: ``wx1..wy2``; ``empty`` marks a 1×1 placeholder."""
    zero = F.lit(0)
    grown = _sized(det, pages, page).withColumns({
        "wx1": F.greatest(zero, F.col("x1") - padding), "wy1": F.greatest(zero, F.col("y1") - padding),
        "wx2": F.least(F.col("_w"), F.col("x2") + padding), "wy2": F.least(F.col("_h"), F.col("y2") + padding),
    }).withColumn("empty", (F.col("wx2") <= F.col("wx1")) | (F.col("wy2") <= F.col("wy1")))
    blank = {c: F.when(F.col("empty"), F.lit(v)).otherwise(F.col(c))
             for c, v in {"wx1": 0, "wy1": 0, "wx2": 1, "wy2": 1}.items()}
    return grown.withColumns(blank).drop("_w", "_h")


def clamp_window(det: DataFrame, pages: DataFrame, *, page: str = "page_id") -> DataFrame:
    """Crop window with each corner clamped to the page: ``wx1..wy2``; zero-size windows are left out."""
    def clamp(c: str, size: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(c), F.col(size)))

    sized = _sized(det, pages, page).withColumns({
        "wx1": clamp("x1", "_w"), "wy1": clamp("y1", "_h"), "wx2": clamp("x2", "_w"), "wy2": clamp("y2", "_h"),
    })
    return sized.where("wx2 > wx1 AND wy2 > wy1").drop("_w", "_h")


def validate_bubbles(df: DataFrame) -> DataFrame:
    """Add ``errors``: names of the fields that break a rule, empty for a good row."""
    checks = {}
    if "corrected_text" in df.columns:
        checks["corrected_text"] = F.col("corrected_text").isNull()
    if "type" in df.columns:
        checks["type"] = ~F.coalesce(F.col("type"), F.lit(BUBBLE_TYPES[0])).isin(*BUBBLE_TYPES)
    if "reading_order" in df.columns:
        checks["reading_order"] = F.coalesce(F.col("reading_order") < 1, F.lit(False))
    if "bbox" in df.columns:
        checks["bbox"] = F.coalesce(F.size("bbox") != 4, F.lit(True))
    if "merge_mode" in df.columns:
        checks["merge_mode"] = ~merge_mode("merge_mode").isin(*MERGE_MODES)
    flagged = F.array(*[F.when(bad, F.lit(field)) for field, bad in checks.items()])
    return df.withColumn("errors", F.filter(flagged, lambda e: e.isNotNull()))


def merge_mode(raw: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(F.col(raw), F.lit("")), F.lit("append"))))


def snap_to_grid(df: DataFrame, *, step: int = 8, columns: Sequence[str] = ("x1", "y1")) -> DataFrame:
    """Nearest multiple of ``step``, halves upward."""
    if not 2 <= step <= 40:
        raise ValueError("grid step must be within 2..40")
    return df.withColumns({c: (half_up(F.col(c) / step) * step).cast("long") for c in columns})


def _snapped(threshold: int):
    """Origins of the moved boxes of a task: whole pages, one ordered walk each way."""
    def work(rows: pa.Table) -> pa.Table:
        moving = rows.column("_row").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        page, owner = codes(rows.column("_page")), codes(rows.column("_owner"))
        origins = []
        marks, boxes = np.flatnonzero(~moving & (page >= 0)), np.flatnonzero(moving & (page >= 0) & (owner >= 0))
        for axis in "xy":
            lo, hi = (rows.column(f"_{axis}{n}").combine_chunks() for n in (1, 2))
            known = [c.is_valid().to_numpy(zero_copy_only=False) for c in (lo, hi)]
            lo, hi = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (lo, hi))
            usable = boxes[known[0][boxes] & known[1][boxes]]
            own = [marks[k[marks]] for k in known]
            event = np.concatenate([*own, usable, usable])
            at = np.concatenate([lo[own[0]], hi[own[1]], lo[usable], hi[usable]])
            probe = np.arange(len(event)) >= len(own[0]) + len(own[1])
            origin, best = np.zeros(len(rows), at.dtype), None
            for found in walk_arrays(page[event], at, owner[event], probe):
                for kind, half in enumerate(np.split(np.flatnonzero(probe), 2)):
                    mark = np.where(found[half] >= 0, at[found[half]], 0)
                    gap = np.where(found[half] >= 0, np.abs(mark - at[half]), threshold + 1)
                    rank = (gap, np.full(len(half), kind), mark)
                    if best is None:
                        best, take = rank, np.ones(len(half), bool)
                    else:
                        take = (rank[0] < best[0]) | (rank[0] == best[0]) & ((rank[1] < best[1]) | (rank[1] == best[1]) & (rank[2] < best[2]))
                        best = tuple(np.where(take, r, q) for r, q in zip(rank, best))
                    origin[usable[take]] = (mark - kind * (hi[usable] - lo[usable]))[take]
            none = np.ones(len(rows), bool)
            none[usable] = ~(best[0] <= threshold)
            origins.append(pa.array(origin, mask=none))
        return pa.table({"_row": rows.column("_row"), "_ox": origins[0], "_oy": origins[1]}).filter(pa.array(moving))

    return lambda batches: whole_keys(batches, "_page", work)


def snap_to_edges(
    moved: DataFrame, boxes: DataFrame, pages: DataFrame, *, threshold: int = 8, page: str = "page_id",
    box: str = "box_id", limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Snap the origin of a moved box to the nearest edge within ``threshold``, per axis.

    Candidates are the page borders and the edges of the other boxes; the leading and the trailing
    edge of the moved box are both tried.  Nearest first, then leading, then the smaller coordinate.
    Rows go to the task of their page and are walked there in order of their coordinates, once each
    way; pages with more than ``limit`` rows are walked in slices of the coordinates
    (:mod:`foliospark.operators.asof`).  Boxes without an id or a page stay.
    """
    whole = {moved.schema[c].dataType.typeName() for c in CORNERS} <= {"byte", "short", "integer", "long"}
    whole &= {boxes.schema[c].dataType.typeName() for c in CORNERS} <= {"byte", "short", "integer", "long"}
    whole &= {pages.schema[c].dataType.typeName() for c in "wh"} <= {"byte", "short", "integer", "long"}
    number = "long" if whole else "double"

    def slim(df: DataFrame, owner: Column, corners: Sequence[Column], row: Column) -> DataFrame:
        return df.select(F.col(page).alias("_page"), owner.alias("_owner"), row.alias("_row"),
                         *[c.cast(number).alias(f"_{n}") for n, c in zip(CORNERS, corners)])

    corners = [F.col(c) for c in CORNERS]
    none = F.lit(None).cast(StructType(moved.schema.fields))
    rows = (slim(moved, F.col(box), corners, F.struct(*[F.col(c) for c in moved.columns]))
            .unionByName(slim(boxes, F.col(box), corners, none))
            # A page is a box of nobody.
            .unionByName(slim(pages, F.lit(None).cast(boxes.schema[box].dataType), [F.lit(0), F.lit(0), F.col("w"), F.col("h")], none)))
    out = StructType([*rows.select("_row").schema.fields, *rows.select(F.col("_x1").alias("_ox"), F.col("_y1").alias("_oy")).schema.fields])

    def cold(rows: DataFrame) -> DataFrame:
        return rows.repartition("_page").sortWithinPartitions("_page").mapInArrow(_snapped(threshold), out)

    hot = hot_keys(rows, ["_page"], limit)
    if hot is None:
        snapped = cold(rows).select("_row.*", "_ox", "_oy")
    elif hot.limit(HOT_KEYS_LITERAL + 1).count() > HOT_KEYS_LITERAL:
        # Slices hold pages of any size; setting the others apart would move all rows twice.
        snapped = _snapped_slices(moved, boxes, pages, threshold, page, box, number)
    else:
        many = [split_hot(df, [page], hot)[1] for df in (moved, boxes, pages)]
        few = cold(split_hot(rows, ["_page"], hot)[0]).select("_row.*", "_ox", "_oy")
        snapped = few.unionByName(_snapped_slices(*many, threshold, page, box, number))
    x, y = (F.coalesce(F.col(f"_o{a}"), F.col(f"{a}1")).cast(moved.schema[f"{a}1"].dataType) for a in "xy")
    return snapped.withColumns({"x1": x, "y1": y, "x2": x + F.col("x2") - F.col("x1"), "y2": y + F.col("y2") - F.col("y1")}
                               ).select(*moved.columns)


def _snapped_slices(moved: DataFrame, boxes: DataFrame, pages: DataFrame, threshold: int, page: str, box: str, number: str) -> DataFrame:
    """``moved`` with the origins its boxes snap to, for pages of any size."""
    # Rows need no id of their own: the number is fixed where it is stored and lives in this step only.
    moved = stored(moved.withColumn("_n", F.monotonically_increasing_id()))

    def events(df: DataFrame, owner: Column, n: Column, corners: dict[str, Column], known: str = "true") -> DataFrame:
        edges = F.array(*[F.struct(F.lit(a).alias("_axis"), F.lit(k).alias("_kind"), corners[f"{c}{k + 1}"].cast(number).alias("_at"))
                          for a, c in enumerate("xy") for k in (0, 1) if known == "true" or c == known])
        return df.select(F.col(page).alias("_page"), owner.alias("_owner"), n.alias("_n"), F.inline(edges))

    at, nobody = {c: F.col(c) for c in CORNERS}, F.lit(None).cast("long")
    edge = {"x1": F.lit(0), "y1": F.lit(0), "x2": F.col("w"), "y2": F.col("h")}
    # A page is a box of nobody.
    rows = events(boxes, F.col(box), nobody, at).unionByName(events(pages, F.lit(None).cast(boxes.schema[box].dataType), nobody, edge))
    for c in "xy":
        whole = moved.where(F.col(box).isNotNull() & F.col(f"{c}1").isNotNull() & F.col(f"{c}2").isNotNull())
        rows = rows.unionByName(events(whole, F.col(box), F.col("_n"), at, c))
    found = near_marks(rows.where("_page is not null and _at is not null"), threshold, 4 * (moved.count() + boxes.count() + pages.count()))
    hit = F.struct("_gap", "_kind", "_mark")
    best = found.groupBy("_n").agg(*[F.min(F.when(F.col("_axis") == a, hit)).alias(f"_s{c}") for a, c in enumerate("xy")])
    origin = [(F.col(f"_s{c}._mark") - F.col(f"_s{c}._kind") * (F.col(f"{c}2") - F.col(f"{c}1")).cast(number)).alias(f"_o{c}") for c in "xy"]
    return moved.join(best, "_n", "left").select(*moved.drop("_n").columns, *origin)


def overlap_pairs(
    det: DataFrame, *, metric: str = "iou", threshold: float = 0.45, by: str = "page_id", id: str = "det_id",
    limit: int | None = PAIR_LIMIT, cell: float = 1, room: int = CELL_ROOM,
) -> DataFrame:
    """Box pairs of a page whose overlap (``iou``, or ``min`` for the smaller area) exceeds ``threshold``.

    On pages above ``limit`` boxes only boxes of one cell meet, and a pair is reported by the
    cell that holds the corner of its intersection, so neither all pairs of the page nor a
    de-duplication is needed.  Cells follow the boxes (:func:`foliospark.operators.quadtree.quad_cells`):
    they hold about ``room`` boxes and are at least ``cell`` wide.
    """
    measure = {"iou": box_iou, "min": box_overlap_min}[metric]
    def side(df: DataFrame, name: str, *cells: str) -> DataFrame:
        return df.select(by, F.col(id).alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in CORNERS], *cells)

    def met(slim: DataFrame, *cells: str) -> DataFrame:
        # Dealt before the columns part, so that both sides may read one exchange.
        slim = slim.repartition(by, *cells)
        joined = side(slim, "a", *cells).join(side(slim, "b", *cells), [by, *cells])
        return joined.where((F.col("a_id") < F.col("b_id")) & boxes_meet("a_", "b_"))

    slim = det.select(by, id, *CORNERS)
    hot = hot_keys(slim, [by], limit)
    if hot is None:
        pairs = met(slim)
    else:
        # One pass and one join tell the pages apart.
        told = slim.join(hot.withColumn("_many", F.lit(True)), same_key(slim, [by], hot, hot.columns), "left").drop(*hot.columns)
        told = stored(told)
        cold, warm = told.where("_many is null").drop("_many"), told.where("_many").drop("_many")
        leaves = quad_cells(warm, [by], room=room, finest=cell)
        home = [in_cell(x, F.greatest(f"a_{x}1", f"b_{x}1")) for x in "xy"]
        pairs = met(cold).unionByName(met(leaves, *CELL).where(home[0] & home[1]).drop(*CELL))
    return (pairs.withColumn("overlap", measure("a_", "b_")).where(F.col("overlap") > threshold)
            .select(by, "a_id", "b_id", "overlap"))


def new_boxes_only(
    new: DataFrame, existing: DataFrame, *, iou: float = 0.45, by: str | Sequence[str] = "panel_id",
    limit: int | None = FOLD_LIMIT, cell: float = 1, room: int = CELL_ROOM,
) -> DataFrame:
    """Drop new boxes whose IoU with an existing box of the panel reaches ``iou``.

    Panels with more than ``limit`` existing boxes meet in cells that hold about ``room`` boxes and are
    at least ``cell`` wide, as in :func:`overlap_pairs`; the other panels meet as they are.
    """
    by = names(by)
    clash = iou_above(iou, inclusive=True)

    def other(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(f"_e_{c}") for c in df.columns])

    def unmet(new: DataFrame, existing: DataFrame) -> DataFrame:
        old = other(existing.select(*by, *CORNERS))
        cond = same_key(new, by, old, [f"_e_{c}" for c in by]) & F.expr(clash("_e_", ""))
        return new.join(old, cond, "left_anti")

    hot = hot_keys(existing, by, limit)
    if hot is None:
        return unmet(new, existing)
    (cold, warm), (cold_old, warm_old) = split_hot(new, by, hot), split_hot(existing, by, hot)
    # Rows need no id of their own: the number is fixed by the checkpoint and lives in this step only.
    warm = cut_lineage(warm.withColumn("_row", F.monotonically_increasing_id()))
    both = warm.select(*by, *CORNERS, "_row").unionByName(warm_old.select(*by, *CORNERS, F.lit(-1).cast("long").alias("_row")))
    leaves = cut_lineage(quad_cells(both, by, room=room, finest=cell))
    near, old, at = leaves.where("_row >= 0"), other(leaves.where("_row < 0")), [*by, *CELL]
    cond = same_key(near, at, old, [f"_e_{c}" for c in at]) & F.expr(clash("_e_", ""))
    met = near.join(old, cond, "left_semi").select("_row").distinct()
    return unmet(cold, cold_old).unionByName(warm.join(met, "_row", "left_anti").drop("_row"))


def append_dedup(
    existing: DataFrame,
    new: DataFrame,
    *,
    iou: float = 0.45,
    by: str = "panel_id",
    mode: str = "append",
    reorder: bool = True,
    limit: int | None = FOLD_LIMIT,
) -> DataFrame:
    """Merge newly detected boxes into the bubbles of a panel.

    ``append`` walks the new boxes in ``pos`` order and skips one whose IoU with an existing or an
    already appended box reaches ``iou``; ids and orders continue the running count, skipping used
    ids.  ``replace`` keeps the new boxes only.  ``reorder`` re-ranks panels with missing orders.
    Result: key, ``bubble_id``, ``pos``, corners, ``reading_order``.
    """
    cols = [by, "bubble_id", "pos", *CORNERS, "reading_order"]
    fresh = new.select(by, "pos", *CORNERS)
    if mode == "replace":
        kept = number_rows(fresh, by, ["pos"], "reading_order")
        out = kept.withColumn("bubble_id", F.concat(F.col(by).cast("string"), F.lit("_b"), F.col("reading_order").cast("string")))
        return out.withColumn("pos", F.col("reading_order")).select(*cols)
    if mode != "append":
        raise ValueError("mode: append | replace")
    old = existing.select(*cols)
    # Groups of the merged list are at most twice as large as the larger of its two parts.
    rank_limit = needed_limit(old, by, GROUP_LIMIT) or needed_limit(fresh, by, GROUP_LIMIT)
    both = (old.select(by, "pos", *CORNERS).withColumn("_new", F.lit(False))
            .unionByName(fresh.withColumn("_new", F.lit(True))).withColumn("_fixed", ~F.col("_new")))
    reach = 3 if iou >= 0.25 else None
    kept = greedy_keep(both, by, ["_new", "pos", *CORNERS], iou_above(iou, inclusive=True), pinned="_fixed",
                       reach=reach, limit=limit)
    added = number_rows(kept.where("_new"), by, ["pos", *CORNERS], "_nth", limit=rank_limit).select(by, "_nth", *CORNERS)
    size = old.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    added = added.join(size, by, "left").withColumn("_start", F.coalesce("_size", F.lit(0)) + 1).drop("_size")
    used = bubble_numbers(old, by, "bubble_id").join(size, by).withColumn("_start", F.col("_size") + 1)
    named = nth_free(added, used, by, nth="_nth", number="_n", start="_start", name="_number", limit=rank_limit)
    named = named.select(
        by, F.concat(F.col(by).cast("string"), F.lit("_b"), F.col("_number").cast("string")).alias("bubble_id"),
        (F.col("_start") + F.col("_nth") - 1).cast("long").alias("pos"), *CORNERS,
        (F.col("_start") + F.col("_nth") - 1).cast("long").alias("reading_order"))
    # Existing bubbles count from 1 in list order, so appended ones follow on.
    listed = number_rows(old.withColumnRenamed("pos", "_pos"), by, ["_pos"], "pos", limit=rank_limit).select(*cols)
    out = listed.withColumn("reading_order", F.col("reading_order").cast("long")).unionByName(named)
    return assign_reading_order(out, by=by, limit=limit) if reorder else out
