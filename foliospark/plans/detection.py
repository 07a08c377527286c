"""Detection queries: decoding, filters, windows, tiles, suppression and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.operators import boxes as B
from foliospark.operators import suppress as S
from foliospark.operators import tiles as T
from foliospark.operators.models import detect
from foliospark.plans.check_sql import CONTAINED, INTER, IOU_ABOVE, IOU_REACHES, greedy, r6, views
from foliospark.plans.fixtures import Tables
from foliospark.skew import number_rows

DET = ["x1", "y1", "x2", "y2", "score", "class_id"]
RANK = "score DESC, x1, y1, x2, y2, class_id"


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison: off the ties that two engines may round apart, and without negative zero."""
    r = F.round(c + F.lit(1e-9), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


# --- raw tensors -----------------------------------------------------------------------------

def tensors(t: Tables, rows: int, width: int):
    cells = ", ".join(f"CAST(embedding[{{}} * {width} + {k}] AS DOUBLE)" for k in range(width)).format(*["i"] * width)
    if width == 6:
        cells = cells.rsplit(", ", 1)[0] + ", CAST(CAST(CAST(embedding[i * 6 + 5] AS DOUBLE) * 10 AS INT) AS DOUBLE)"
    return t.read("embeddings").selectExpr(
        "vec_id AS page_id", f"transform(sequence(0, {rows - 1}), i -> array({cells})) AS raw")


def _decoded(df):
    return df.select("page_id", "det_id", *[rounded(F.col(c)).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])


def decode_detections(spark, d):
    return _decoded(B.decode_detections(tensors(Tables(spark, d), 10, 6), num_classes=2, class_id=0))


def decode_single_class(spark, d):
    return _decoded(B.decode_detections(tensors(Tables(spark, d), 5, 12), num_classes=1))


def decode_multi_class(spark, d):
    return _decoded(B.decode_detections(tensors(Tables(spark, d), 6, 10), num_classes=2, class_id=1, conf=0.01))


def _e(i: str) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


_DECODE_ROWS = f"""
WITH cell AS (
  SELECT vec_id AS page_id, i, {_e('i*6+1')} AS a, {_e('i*6+2')} AS b, {_e('i*6+3')} AS c, {_e('i*6+4')} AS d,
         {_e('i*6+5')} AS score, trunc({_e('i*6+6')} * 10) AS class
  FROM embeddings, range(10) AS g(i))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS det_id, {r6('score')} AS score,
       {r6('(a + c) / 2 - (c - a) / 2')} AS x1, {r6('(b + d) / 2 - (d - b) / 2')} AS y1,
       {r6('(a + c) / 2 + (c - a) / 2')} AS x2, {r6('(b + d) / 2 + (d - b) / 2')} AS y2
FROM cell WHERE class = 0"""


def _decode_columns(width: int, score_row: int, where: str) -> str:
    v = [_e(f"{r * width} + i + 1") for r in (0, 1, 2, 3, score_row)]
    return f"""
SELECT vec_id AS page_id, CAST(i AS INT) AS det_id, {r6(v[4])} AS score,
       {r6(f'{v[0]} - {v[2]} / 2')} AS x1, {r6(f'{v[1]} - {v[3]} / 2')} AS y1,
       {r6(f'{v[0]} + {v[2]} / 2')} AS x2, {r6(f'{v[1]} + {v[3]} / 2')} AS y2
FROM embeddings, range({width}) AS g(i) WHERE {where.format(v[4])}"""


# --- filters and windows ----------------------------------------------------------------------

def filter_score(spark, d):
    return B.filter_score(Tables(spark, d).det(), conf=350)


def to_corners(spark, d):
    centred = B.to_centres(Tables(spark, d).det()).drop("x1", "y1", "x2", "y2")
    return B.to_corners(centred)


def rescale_clip(spark, d):
    t = Tables(spark, d)
    return B.rescale_clip(t.det(), t.page(), input_size=640)


def filter_min_area(spark, d):
    return B.filter_min_area(Tables(spark, d).det(), min_area=60_000)


def normalize_bbox(spark, d):
    raw = Tables(spark, d).det().selectExpr(
        "page_id", "score", "class_id",
        "CASE WHEN score % 10 = 0 THEN array(x1 / 2D, y1 / 2D, x2 / 2D) ELSE array(x2 / 2D, y1 / 2D, x1 / 2D, y2 / 4D) END AS bbox")
    return B.normalize_bbox(raw).drop("bbox")


def padded_window(spark, d):
    t = Tables(spark, d)
    return B.padded_window(t.det().selectExpr("page_id", "x1 + 600 AS x1", "y1 + 500 AS y1", "x2 + 600 AS x2", "y2 + 500 AS y2", "score"),
                           t.page(), padding=12)


def clamp_window(spark, d):
    t = Tables(spark, d)
    return B.clamp_window(t.det().selectExpr("page_id", "x1 + 600 AS x1", "y1 + 600 AS y1", "x2 + 600 AS x2", "y2 + 600 AS y2", "score"),
                          t.page())


def validate_bubbles(spark, d):
    rows = Tables(spark, d).read("conversations").selectExpr(
        "conv_id AS panel_id", "turn", "CASE WHEN conv_id % 7 <> 0 THEN text END AS corrected_text",
        "CASE WHEN turn % 4 = 3 THEN 'robot' WHEN role = 'user' THEN 'speech' WHEN role = 'assistant' THEN 'narration' END AS type",
        "turn - 1 AS reading_order", "CASE WHEN conv_id % 5 = 0 THEN array(1, 2, 3) ELSE array(1, 2, 3, 4) END AS bbox",
        "element_at(array('append', ' Replace ', '', 'merge'), CAST(turn % 4 + 1 AS INT)) AS merge_mode")
    return B.validate_bubbles(rows).select("panel_id", "turn", F.array_join("errors", ",").alias("errors"))


def snap_to_grid(spark, d):
    return B.snap_to_grid(Tables(spark, d).det(), step=8)


def _numbered_det(t: Tables):
    return number_rows(t.det(), "page_id", [-F.col("score"), "x1", "y1", "x2", "y2", "class_id"], "det_id")


def snap_to_edges(spark, d):
    t = Tables(spark, d)
    all_boxes = _numbered_det(t).select("page_id", F.col("det_id").alias("box_id"), "x1", "y1", "x2", "y2")
    return B.snap_to_edges(all_boxes, all_boxes, t.page(), threshold=8)


# --- tiles ------------------------------------------------------------------------------------

def plan_tiles(spark, d):
    return T.plan_tiles(Tables(spark, d).page())


def tile_det(t: Tables):
    return t.det().withColumn("tile_no", (F.col("score") % 12).cast("int"))


def translate_tiles(spark, d):
    t = Tables(spark, d)
    return T.translate_tiles(tile_det(t), t.page())


def merge_tile_boxes(spark, d):
    t = Tables(spark, d)
    moved = T.translate_tiles(tile_det(t), t.page()).drop("tile_no")
    return S.merge_tile_boxes(moved, conf=120, iou=0.45, by="page_id")


def union_tiles(spark, d):
    t = Tables(spark, d)
    moved = T.translate_tiles(tile_det(t), t.page())
    parts = [B.filter_score(moved.where(f"class_id = {c}"), conf=120) for c in (0, 1)]
    return T.union_tiles(*parts).groupBy("page_id", "class_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("x1").alias("sum_x1"), F.sum("y2").alias("sum_y2"))


TILES_SQL = """
axis AS (
  SELECT page_id, w, h,
         CASE WHEN w <= 640 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, w, 512), w - 640))) END AS xs,
         CASE WHEN h <= 640 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, h, 512), h - 640))) END AS ys
  FROM page),
tile_y AS (SELECT *, unnest(range(1, len(ys) + 1)) AS j FROM axis),
tile_xy AS (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM tile_y),
tile AS (
  SELECT page_id, CAST((j - 1) * len(xs) + i - 1 AS INT) AS tile_no, CAST(xs[i] AS INT) AS tx1, CAST(ys[j] AS INT) AS ty1,
         CAST(least(xs[i] + 640, w) AS INT) AS tx2, CAST(least(ys[j] + 640, h) AS INT) AS ty2
  FROM tile_xy)"""
MOVED_SQL = """
moved AS (
  SELECT d.page_id, d.x1 + tx1 AS x1, d.y1 + ty1 AS y1, d.x2 + tx1 AS x2, d.y2 + ty1 AS y2, score, class_id,
         CAST(score % 12 AS INT) AS tile_no
  FROM det d JOIN tile t ON t.page_id = d.page_id AND t.tile_no = d.score % 12)"""


# --- suppression and pairs ----------------------------------------------------------------------

def nms(spark, d):
    return S.nms(Tables(spark, d).det(), conf=350)


def nms_large_pages(spark, d):
    """The way of pages too large for one array, taken by every page above six boxes."""
    return S.nms(Tables(spark, d).det(), conf=350, limit=6)


def suppress_contained(spark, d):
    return S.suppress_contained(B.filter_score(Tables(spark, d).det(), conf=350))


def overlap_pairs(spark, d):
    return B.overlap_pairs(_numbered_det(Tables(spark, d)), threshold=0.45).withColumn("overlap", rounded(F.col("overlap")))


def overlap_pairs_large_pages(spark, d):
    """The way of crowded pages, taken by every page above six boxes, with cells of about four."""
    pairs = B.overlap_pairs(_numbered_det(Tables(spark, d)), threshold=0.45, limit=6, room=4)
    return pairs.withColumn("overlap", rounded(F.col("overlap")))


def containment_pairs(spark, d):
    pairs = B.overlap_pairs(_numbered_det(Tables(spark, d)), metric="min", threshold=0.7)
    return pairs.withColumn("overlap", rounded(F.col("overlap")))


def new_boxes_only(spark, d):
    det = Tables(spark, d).det()
    return B.new_boxes_only(det.where("class_id = 1"), det.where("class_id = 0"), by="page_id")


def new_boxes_large_pages(spark, d):
    """The way of crowded panels, taken above three existing boxes, with cells of about four."""
    det = Tables(spark, d).det()
    return B.new_boxes_only(det.where("class_id = 1"), det.where("class_id = 0"), by="page_id", limit=3, room=4)


def snap_large_pages(spark, d):
    """The way of pages too large for one task, taken by every page above six rows."""
    t = Tables(spark, d)
    all_boxes = _numbered_det(t).select("page_id", F.col("det_id").alias("box_id"), "x1", "y1", "x2", "y2")
    return B.snap_to_edges(all_boxes, all_boxes, t.page(), threshold=8, limit=6)


class _FormulaDetector:
    """Stand-in model: boxes by arithmetic on the page size."""

    def __call__(self, batch):
        return [[(k * 100 + w % 7, k * 50 + h % 5, k * 100 + 90, k * 50 + 60, (w + k) % 10 / 10.0, k % 2) for k in range(w % 4)]
                for w, h in zip(batch["w"], batch["h"])]


def detect_pages(spark, d):
    return detect(Tables(spark, d).page().select("page_id", "w", "h"), _FormulaDetector, keys=["page_id"])


_NUMBERED = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {RANK}) AS det_id FROM det)"""


def _pairs_sql(test: str, value: str) -> str:
    return f"""{views('det')},{_NUMBERED}
SELECT k.page_id AS page_id, k.det_id AS a_id, b.det_id AS b_id, {r6(value)} AS overlap
FROM numbered k JOIN numbered b ON k.page_id = b.page_id AND k.det_id < b.det_id WHERE {test}"""


_UNION = f"({INTER}) / CAST((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - ({INTER}) AS DOUBLE)"
_SMALLER = f"({INTER}) / CAST(least((k.x2 - k.x1) * (k.y2 - k.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS DOUBLE)"


def _snap_axis(a: str, size: str) -> str:
    return f"""
edge_{a} AS (
  SELECT page_id, det_id AS owner, unnest([{a}1, {a}2]) AS pos FROM numbered
  UNION ALL SELECT page_id, -1, unnest([0, {size}]) FROM page),
near_{a} AS (
  SELECT b.page_id, b.det_id, k.kind, e.pos, abs(e.pos - k.edge) AS gap,
         CASE WHEN k.kind = 0 THEN e.pos ELSE e.pos - (b.{a}2 - b.{a}1) END AS origin
  FROM numbered b
  JOIN (SELECT page_id, det_id, 0 AS kind, {a}1 AS edge FROM numbered
        UNION ALL SELECT page_id, det_id, 1, {a}2 FROM numbered) k ON k.page_id = b.page_id AND k.det_id = b.det_id
  JOIN edge_{a} e ON e.page_id = b.page_id AND e.owner <> b.det_id AND abs(e.pos - k.edge) <= 8),
best_{a} AS (
  SELECT page_id, det_id, origin FROM near_{a}
  QUALIFY row_number() OVER (PARTITION BY page_id, det_id ORDER BY gap, kind, pos) = 1)"""


_SNAP_EDGES = f"""{views('det', 'page')},{_NUMBERED},{_snap_axis('x', 'w')},{_snap_axis('y', 'h')}
SELECT n.page_id AS page_id, n.det_id AS box_id, coalesce(bx.origin, n.x1) AS x1, coalesce(b2.origin, n.y1) AS y1,
       coalesce(bx.origin, n.x1) + n.x2 - n.x1 AS x2, coalesce(b2.origin, n.y1) + n.y2 - n.y1 AS y2
FROM numbered n LEFT JOIN best_x bx ON bx.page_id = n.page_id AND bx.det_id = n.det_id
LEFT JOIN best_y b2 ON b2.page_id = n.page_id AND b2.det_id = n.det_id"""


def _scaled(c: str, size: str) -> str:
    return f"CAST(greatest(0, least(trunc({c} * (CAST({size} AS DOUBLE) / 640)), {size})) AS INT) AS {c}"


_DET_OUT = "page_id, x1, y1, x2, y2, score, class_id"

QUERIES = {f.__name__: f for f in (
    decode_detections, decode_single_class, decode_multi_class, filter_score, to_corners, rescale_clip, filter_min_area,
    normalize_bbox, padded_window, clamp_window, validate_bubbles, snap_to_grid, snap_to_edges, plan_tiles,
    translate_tiles, merge_tile_boxes, union_tiles, nms, nms_large_pages, suppress_contained, overlap_pairs, containment_pairs,
    new_boxes_only, detect_pages, overlap_pairs_large_pages, new_boxes_large_pages, snap_large_pages)}

_NMS = f"""{views('det', recursive=True)}, strong AS (SELECT * FROM det WHERE score > 350),
{greedy('kept', 'strong', 'page_id', DET, RANK, IOU_ABOVE)}
SELECT {_DET_OUT} FROM kept"""

ORACLE = {
    "decode_detections": _DECODE_ROWS,
    "decode_single_class": _decode_columns(12, 4, "true"),
    "decode_multi_class": _decode_columns(10, 5, "{} > 0.01::DOUBLE"),
    "filter_score": f"{views('det')} SELECT {_DET_OUT} FROM det WHERE score > 350",
    "to_corners": f"""{views('det')} SELECT page_id, score, class_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
       CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy,
       x2 - x1 AS bw, y2 - y1 AS bh FROM det""",
    "rescale_clip": f"""{views('det', 'page')} SELECT d.page_id, {_scaled('x1', 'w')}, {_scaled('y1', 'h')}, {_scaled('x2', 'w')},
       {_scaled('y2', 'h')}, score, class_id FROM det d JOIN page p ON p.page_id = d.page_id""",
    "filter_min_area": f"""{views('det')} SELECT {_DET_OUT} FROM det
       WHERE greatest(0, x2 - x1) * greatest(0, y2 - y1) >= 60000""",
    "normalize_bbox": f"""{views('det')},
half AS (SELECT page_id, score, class_id, score % 10 <> 0 AS valid, CAST(round_even(x2 / 2.0::DOUBLE, 0) AS INT) AS a,
                CAST(round_even(y1 / 2.0::DOUBLE, 0) AS INT) AS b, CAST(round_even(x1 / 2.0::DOUBLE, 0) AS INT) AS c,
                CAST(round_even(y2 / 4.0::DOUBLE, 0) AS INT) AS d FROM det)
SELECT page_id, score, class_id, valid, CASE WHEN valid THEN least(a, c) END AS x1, CASE WHEN valid THEN least(b, d) END AS y1,
       CASE WHEN valid THEN greatest(a, c) END AS x2, CASE WHEN valid THEN greatest(b, d) END AS y2 FROM half""",
    "padded_window": f"""{views('det', 'page')},
box AS (SELECT page_id, x1 + 600 AS x1, y1 + 500 AS y1, x2 + 600 AS x2, y2 + 500 AS y2, score FROM det),
win AS (SELECT b.*, greatest(0, x1 - 12) AS a, greatest(0, y1 - 12) AS c, least(w, x2 + 12) AS e, least(h, y2 + 12) AS g
        FROM box b JOIN page p ON p.page_id = b.page_id)
SELECT page_id, x1, y1, x2, y2, score, (e <= a OR g <= c) AS empty,
       CASE WHEN e <= a OR g <= c THEN 0 ELSE a END AS wx1, CASE WHEN e <= a OR g <= c THEN 0 ELSE c END AS wy1,
       CASE WHEN e <= a OR g <= c THEN 1 ELSE e END AS wx2, CASE WHEN e <= a OR g <= c THEN 1 ELSE g END AS wy2 FROM win""",
    "clamp_window": f"""{views('det', 'page')},
box AS (SELECT page_id, x1 + 600 AS x1, y1 + 600 AS y1, x2 + 600 AS x2, y2 + 600 AS y2, score FROM det),
win AS (SELECT b.*, greatest(0, least(x1, w)) AS wx1, greatest(0, least(y1, h)) AS wy1, greatest(0, least(x2, w)) AS wx2,
               greatest(0, least(y2, h)) AS wy2 FROM box b JOIN page p ON p.page_id = b.page_id)
SELECT * FROM win WHERE (wx2 - wx1) * (wy2 - wy1) > 0 AND wx2 > wx1""",
    "validate_bubbles": """
SELECT conv_id AS panel_id, turn, array_to_string(list_filter([
         CASE WHEN conv_id % 7 = 0 THEN 'corrected_text' END,
         CASE WHEN turn % 4 = 3 THEN 'type' END,
         CASE WHEN turn - 1 < 1 THEN 'reading_order' END,
         CASE WHEN conv_id % 5 = 0 THEN 'bbox' END,
         CASE WHEN turn % 4 = 3 THEN 'merge_mode' END], lambda e: e IS NOT NULL), ',') AS errors
FROM conversations""",
    "snap_to_grid": f"""{views('det')} SELECT page_id, CAST(floor(x1 / 8.0::DOUBLE + 0.5::DOUBLE) * 8 AS BIGINT) AS x1,
       CAST(floor(y1 / 8.0::DOUBLE + 0.5::DOUBLE) * 8 AS BIGINT) AS y1, x2, y2, score, class_id FROM det""",
    "snap_to_edges": _SNAP_EDGES,
    "plan_tiles": f"{views('page')},{TILES_SQL} SELECT page_id, tile_no, tx1, ty1, tx2, ty2 FROM tile",
    "translate_tiles": f"""{views('page', 'det')},{TILES_SQL},{MOVED_SQL}
SELECT page_id, x1, y1, x2, y2, score, class_id, tile_no FROM moved""",
    "merge_tile_boxes": f"""{views('page', 'det', recursive=True)},{TILES_SQL},{MOVED_SQL},
strong AS (SELECT * FROM moved WHERE score > 120),
{greedy('kept', 'strong', 'page_id', DET, RANK, IOU_ABOVE)}
SELECT {_DET_OUT} FROM kept""",
    "union_tiles": f"""{views('page', 'det')},{TILES_SQL},{MOVED_SQL}
SELECT page_id, class_id, count(*) AS boxes, CAST(sum(x1) AS BIGINT) AS sum_x1, CAST(sum(y2) AS BIGINT) AS sum_y2
FROM moved WHERE score > 120 GROUP BY page_id, class_id""",
    "nms": _NMS,
    "nms_large_pages": _NMS,
    "suppress_contained": f"""{views('det', recursive=True)}, strong AS (SELECT * FROM det WHERE score > 350),
{greedy('kept', 'strong', 'page_id', DET, RANK, CONTAINED)}
SELECT {_DET_OUT} FROM kept""",
    "overlap_pairs": _pairs_sql(IOU_ABOVE, _UNION),
    "containment_pairs": _pairs_sql(CONTAINED, _SMALLER),
    "new_boxes_only": f"""{views('det')}
SELECT {_DET_OUT} FROM det b WHERE class_id = 1 AND NOT EXISTS (
  SELECT 1 FROM det k WHERE k.class_id = 0 AND k.page_id = b.page_id AND {IOU_REACHES})""",
    "detect_pages": f"""{views('page')}
SELECT page_id, CAST(k AS INT) AS det_id, CAST(k * 100 + w % 7 AS DOUBLE) AS x1, CAST(k * 50 + h % 5 AS DOUBLE) AS y1,
       CAST(k * 100 + 90 AS DOUBLE) AS x2, CAST(k * 50 + 60 AS DOUBLE) AS y2, ((w + k) % 10) / 10.0::DOUBLE AS score,
       CAST(k % 2 AS INT) AS class_id
FROM page, range(4) AS g(k) WHERE k < w % 4""",
}
ORACLE |= {"overlap_pairs_large_pages": ORACLE["overlap_pairs"], "new_boxes_large_pages": ORACLE["new_boxes_only"],
           "snap_large_pages": ORACLE["snap_to_edges"]}
