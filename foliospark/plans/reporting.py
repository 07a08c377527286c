"""Totals, benchmark and quality reports, timelines, and image jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.maps import map_mean as mean_of_map
from foliospark.operators import images as I
from foliospark.operators import reports as R
from foliospark.operators import timeline as T
from foliospark.operators.models import recognize
from foliospark.plans.check_sql import r6, views
from foliospark.plans.detection import rounded
from foliospark.plans.fixtures import Tables
from foliospark.skew import number_rows


def source_totals(spark, d):
    t = Tables(spark, d)
    return R.source_totals(t.page().withColumn("failed", F.col("page_id") % 13 == 0), t.det().where("score > 350"))


def _stage(t: Tables):
    panels = t.read("documents").selectExpr(
        "source AS project", "doc_id AS panel_id", "n_chars % 6 <> 0 AS readable", "n_chars % 13 AS detector_ms")
    bubbles = t.read("conversations").selectExpr("conv_id AS panel_id", "turn * 3 + conv_id % 5 AS ocr_ms")
    return panels, bubbles


def stage_stats(spark, d):
    return R.stage_stats(*_stage(Tables(spark, d)))


def stage_errors(spark, d):
    return R.stage_errors(_stage(Tables(spark, d))[0])


def _runs(t: Tables):
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
    return t.read("events").selectExpr(
        "user_id AS file", "event_type AS mode", "event_id", f"{k} AS k", "CAST(value AS INT) AS ms").selectExpr(
        "file", "mode", "event_id",
        "map_concat(map('yolo_ms', CAST(ms AS DOUBLE), 'total_ms', CAST(ms * 8 + k AS DOUBLE)), "
        "if(k % 2 = 0, map('sam_encoder_ms', CAST(k AS DOUBLE)), map('other', 1D))) AS timings")


def benchmark_rows(spark, d):
    return R.benchmark_rows(_runs(Tables(spark, d)))


def benchmark_summary(spark, d):
    rows = R.benchmark_rows(_runs(Tables(spark, d))).withColumn("error", F.when(F.col("file") % 7 == 0, F.lit("failed")))
    return R.benchmark_summary(rows, error="error").withColumn("avg_total_ms", rounded(F.col("avg_total_ms")))


def map_mean(spark, d):
    return mean_of_map(_runs(Tables(spark, d)), "timings", ["mode"]).withColumn("mean", rounded(F.col("mean")))


def _read_texts(t: Tables):
    return t.bubble().selectExpr("panel_id", "bubble_id", "CASE WHEN pos % 3 = 2 THEN ' \n ' ELSE concat(' ', raw_text) END AS raw_text",
                                 "CASE WHEN panel_id % 11 = 0 THEN 'unreadable' END AS error")


def ocr_report(spark, d):
    return R.ocr_report(_read_texts(Tables(spark, d)), error="error")


def bubble_texts(spark, d):
    return R.bubble_texts(_read_texts(Tables(spark, d))).select("panel_id", "bubble_id", "text_len", "text_preview")


def _grid(t: Tables):
    rows = number_rows(t.read("embeddings"), "label", ["vec_id"], "_row")
    return rows.select(F.col("label").alias("image"), (F.col("_row") - 1).alias("y"), F.posexplode("embedding").alias("x", "_v")).select(
        "image", "y", "x", (F.col("_v").cast("double") * 255).alias("value"))


def seam_score(spark, d):
    scored = R.seam_score(_grid(Tables(spark, d)), block=8)
    return scored.select("image", rounded(F.col("score")).alias("score"), R.classify_seam(F.col("score")).alias("grade"))


def _polygons(t: Tables):
    return t.read("part").selectExpr("p_partkey", "p_brand", "CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 3 + p_size % 4 END AS n").select(
        "p_partkey", "p_brand", F.expr(
            "transform(sequence(0, n - 1), i -> named_struct('x', (p_partkey * 31 + i * 197) % 1000 - 20, 'y', (p_partkey * 17 + i * 263) % 1400 - 20))"
        ).alias("points"), F.lit(900).cast("long").alias("w"), F.lit(1300).cast("long").alias("h"))


def polygon_stats(spark, d):
    return R.polygon_stats(_polygons(Tables(spark, d))).drop("points", "w", "h")


def largest_polygon(spark, d):
    return R.largest_polygon(_polygons(Tables(spark, d)), by="p_brand", id="p_partkey")


def seeded_clusters(spark, d):
    """Parts as points (size, price band), one cloud per brand."""
    shaped = Tables(spark, d).read("part").select("p_brand", F.expr("array(cast(p_size as double), cast(p_retailprice / 40 as double))").alias("point"))
    return R.seeded_clusters(shaped, by="p_brand").select("p_brand", "members", "spread", F.col("centre")[0].alias("size"), F.col("centre")[1].alias("price"))


def dominant_cluster(spark, d):
    found = R.dominant_cluster(Tables(spark, d).read("embeddings"), by="label", point="embedding")
    total = F.aggregate("centre", F.lit(0.0), lambda t, x: t + x)
    return found.select("label", "cluster", "members", F.size("centre").alias("dims"), F.round(total, 4).alias("centre_sum"))


# --- timelines -----------------------------------------------------------------------------------

def fit_16_9(spark, d):
    return T.fit_16_9(Tables(spark, d).page().selectExpr("page_id", "w * (1 + page_id % 3) AS w", "h"))


def frame_schedule(spark, d):
    clips = Tables(spark, d).page().selectExpr("page_id", "CAST(2 + page_id % 4 AS DOUBLE) + 0.125D AS duration")
    return T.frame_schedule(clips, fps=4).withColumn("zoom", rounded(F.col("zoom")))


def clip_timeline(spark, d):
    clips = Tables(spark, d).page().selectExpr("source_id", "page_id", "name", "2 + page_id % 4 AS duration", "page_id % 9 <> 0 AS there")
    return T.clip_timeline(clips, exists="there")


def _keypoints(t: Tables):
    points = F.expr("transform(sequence(0, 31), i -> named_struct('x', CAST(embedding[2 * i] AS DOUBLE), 'y', CAST(embedding[2 * i + 1] AS DOUBLE)))")
    return t.read("embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), points.alias("points"))


def relative_keypoints(spark, d):
    frames = _keypoints(Tables(spark, d))
    source = frames.groupBy("clip").agg(F.max_by("points", "frame").alias("points"))
    moved = T.relative_keypoints(frames, source)
    return moved.select("clip", "frame", F.posexplode("points").alias("k", "_p")).select(
        "clip", "frame", "k", rounded(F.col("_p.x")).alias("x"), rounded(F.col("_p.y")).alias("y"))


# --- images --------------------------------------------------------------------------------------

def _images(t: Tables, channels: int = 1):
    side = 8 if channels == 1 else 4
    byte = "CAST(abs(CAST(v AS DOUBLE)) * 400 AS INT)"
    value = f"CASE WHEN label % 2 = 0 THEN 255 - {byte} ELSE {byte} END"
    return t.read("embeddings").selectExpr(
        "vec_id AS page_id", f"unhex(array_join(transform(embedding, v -> lpad(hex({value}), 2, '0')), '')) AS _data").select(
        "page_id", F.struct(F.format_string("mem:%d", "page_id").alias("origin"), F.lit(side).alias("height"), F.lit(side).alias("width"),
                            F.lit(channels).alias("nChannels"), F.lit(I.CV_MODE[channels]).alias("mode"), F.col("_data").alias("data")).alias("image"))


def _hex(image: str):
    return F.lower(F.hex(f"{image}.data"))


def invert_dark(spark, d):
    out = _images(Tables(spark, d)).select("page_id", I.invert_dark("image").alias("image"))
    return out.select("page_id", _hex("image").alias("bytes"))


def mean_luminance(spark, d):
    return _images(Tables(spark, d)).select("page_id", rounded(I.mean_luminance("image")).alias("luminance"))


def image_seam_score(spark, d):
    return _images(Tables(spark, d)).select("page_id", rounded(I.image_seam_score("image", block=4)).alias("score"))


def composite_on_white(spark, d):
    out = _images(Tables(spark, d), 4).select("page_id", I.composite_on_white("image").alias("image"))
    return out.select("page_id", "image.nChannels", _hex("image").alias("bytes"))


def crop_regions(spark, d):
    pages = _images(Tables(spark, d))
    windows = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("det_id")).selectExpr(
        "page_id", "det_id", "CAST(page_id % 3 AS INT) AS wx1", "det_id AS wy1", "CAST(page_id % 3 + 2 + det_id AS INT) AS wx2", "det_id * 2 + 3 AS wy2",
        "page_id % 10 = 0 AS empty")
    out = I.crop_regions(pages, windows)
    return out.select("page_id", "det_id", "crop.width", "crop.height", _hex("crop").alias("bytes"))


def _local_reader():
    return lambda crops: [c["data"].decode("utf-8") if len(c["data"]) % 2 else " " for c in crops]


def _cloud_reader():
    return lambda crops: [f"cloud {len(c['data'])}" for c in crops]


def recognize_crops(spark, d):
    crops = Tables(spark, d).read("conversations").selectExpr(
        "conv_id", "turn", "named_struct('origin', '', 'height', 1, 'width', 1, 'nChannels', 1, 'mode', 0, "
        "'data', CASE WHEN turn = 5 THEN encode('', 'UTF-8') ELSE encode(text, 'UTF-8') END) AS crop")
    return recognize(crops, _local_reader, _cloud_reader, keys=["conv_id", "turn"]).drop("ocr_ms")


_RUNS_SQL = """
runs AS (SELECT user_id AS file, event_type AS mode, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
                CAST(trunc(value) AS INT) AS ms FROM events),
means AS (SELECT file, mode, sum(ms)::DOUBLE / count(*) AS yolo, sum(CASE WHEN k % 2 = 0 THEN k ELSE 0 END)::DOUBLE / count(*) AS enc,
                 sum(ms * 8 + k)::DOUBLE / count(*) AS total FROM runs GROUP BY file, mode)"""
_READ_SQL = """
read_text AS (SELECT panel_id, bubble_id, CASE WHEN pos % 3 = 2 THEN '' ELSE trim(raw_text) END AS clean,
                     panel_id % 11 = 0 AS failed FROM bubble)"""
_GRID_SQL = """
ranked AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings),
grid AS (SELECT label AS image, y, x - 1 AS x, CAST(embedding[x] AS DOUBLE) * 255 AS value FROM ranked, range(1, 65) AS g(x)),
seams AS (
  SELECT a.image, 'x' AS axis, b.x AS at_line, avg(abs(a.value - b.value)) AS jump FROM grid a
  JOIN grid b ON b.image = a.image AND b.y = a.y AND b.x = a.x + 1 WHERE b.x % 8 = 0 GROUP BY a.image, b.x
  UNION ALL
  SELECT a.image, 'y', b.y, avg(abs(a.value - b.value)) FROM grid a
  JOIN grid b ON b.image = a.image AND b.x = a.x AND b.y = a.y + 1 WHERE b.y % 8 = 0 GROUP BY a.image, b.y),
size AS (SELECT image, max(y) + 1 AS h FROM grid GROUP BY image),
scored AS (SELECT s.image, CASE WHEN any_value(h) >= 16 THEN avg(jump) END AS score FROM size s LEFT JOIN seams e ON e.image = s.image GROUP BY s.image)"""
_POLY_SQL = """
poly AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 3 + p_size % 4 END AS n FROM part),
pt AS (SELECT p_partkey, p_brand, n, i, (p_partkey * 31 + i * 197) % 1000 - 20 AS x, (p_partkey * 17 + i * 263) % 1400 - 20 AS y,
              (p_partkey * 31 + ((i + 1) % n) * 197) % 1000 - 20 AS nx, (p_partkey * 17 + ((i + 1) % n) * 263) % 1400 - 20 AS ny
       FROM poly, range(6) AS g(i) WHERE i < n),
shape AS (SELECT p_partkey, p_brand, n, greatest(0, min(x)) AS x1, greatest(0, min(y)) AS y1, least(900, max(x)) AS x2,
                 least(1300, max(y)) AS y2, abs(CAST(sum(x * ny - nx * y) AS DOUBLE)) / 2 AS area FROM pt GROUP BY p_partkey, p_brand, n)"""
_BYTES_SQL = """
img AS (SELECT vec_id AS page_id, label, list_transform(embedding, lambda v: CAST(
          CASE WHEN label % 2 = 0 THEN 255 - trunc(abs(CAST(v AS DOUBLE)) * 400) ELSE trunc(abs(CAST(v AS DOUBLE)) * 400) END AS INT)) AS px
        FROM embeddings)"""


def _hex_sql(numbers: str) -> str:
    return f"array_to_string(list_transform({numbers}, lambda v: printf('%02x', CAST(v AS INT))), '')"


_FIT_SQL = """
size AS (SELECT o_orderkey AS page_id, CAST((1000 + o_orderkey % 200) * (1 + o_orderkey % 3) AS BIGINT) AS w, CAST(1400 + o_orderkey % 300 AS INT) AS h FROM orders),
fit AS (SELECT page_id, w, h, CAST(w AS DOUBLE) AS wd, CAST(h AS DOUBLE) AS hd,
               least(1920::DOUBLE / w, 1080::DOUBLE / h) AS s, 1920::DOUBLE / 1080 AS ar FROM size),
sized AS (SELECT page_id, w, h, CASE WHEN abs(wd / hd - 16::DOUBLE / 9) < 0.2::DOUBLE THEN 'smart_crop' WHEN wd / hd < 1 THEN 'dominant_color'
                 ELSE 'blurred_pillarbox' END AS mode,
                 greatest(1, CAST(trunc(wd * s) AS BIGINT)) AS fit_w, greatest(1, CAST(trunc(hd * s) AS BIGINT)) AS fit_h,
                 CASE WHEN wd / hd > ar THEN CAST(trunc(hd * ar) AS BIGINT) ELSE w END AS crop_w,
                 CASE WHEN wd / hd > ar THEN h ELSE CAST(trunc(wd / ar) AS BIGINT) END AS crop_h FROM fit)"""


QUERIES = {f.__name__: f for f in (
    source_totals, stage_stats, stage_errors, benchmark_rows, benchmark_summary, map_mean, ocr_report, bubble_texts,
    seam_score, polygon_stats, largest_polygon, dominant_cluster, seeded_clusters, fit_16_9, frame_schedule, clip_timeline,
    relative_keypoints, invert_dark, mean_luminance, image_seam_score, composite_on_white, crop_regions, recognize_crops)}

_MOVED = "".join(f"""
a{n} AS (SELECT label, v, arg_min(c, d) AS c FROM (SELECT p.label, p.n, p.v, m.c, struct_pack(d := list_sum(list_transform(
    generate_series(1, len(p.v)), lambda i: (p.v[i] - m.m[i]) * (p.v[i] - m.m[i]))), c := m.c) AS d FROM p JOIN c{n} m USING (label)) GROUP BY label, n, v),
x{n} AS (SELECT label, c, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM a{n}),
y{n} AS (SELECT label, c, i, round(avg(x), 6) AS x, count(*) AS members FROM x{n} GROUP BY label, c, i),
c{n + 1} AS (SELECT label, c, max(members) AS members, list(x ORDER BY i) AS m FROM y{n} GROUP BY label, c),""" for n in range(3))

ORACLE = {
    "dominant_cluster": f"""
WITH p AS (SELECT label, vec_id AS n, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
c0 AS (SELECT label, c - 1 AS c, v AS m FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) AS c
       FROM (SELECT DISTINCT label, v FROM p)) WHERE c <= 3),{_MOVED}
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY members DESC, c) AS k FROM c3)
SELECT label, c::INTEGER AS cluster, members, len(m)::INTEGER AS dims, round(list_sum(m), 4) AS centre_sum FROM r WHERE k = 1""",
    "source_totals": f"""{views('page', 'det')},
found AS (SELECT page_id, count(*) AS n FROM det WHERE score > 350 GROUP BY page_id)
SELECT source_id, count(*) AS pages_processed, CAST(sum(CASE WHEN p.page_id % 13 = 0 THEN 0 ELSE coalesce(n, 0) END) AS BIGINT) AS panels_total
FROM page p LEFT JOIN found f ON f.page_id = p.page_id GROUP BY source_id""",
    "stage_stats": """
WITH p AS (SELECT doc_id, source AS project, n_chars % 6 <> 0 AS ok, n_chars % 13 AS detector FROM documents),
b AS (SELECT conv_id, count(*) AS n, sum(turn * 3 + conv_id % 5) AS ms FROM conversations GROUP BY conv_id)
SELECT project, count(*) FILTER (WHERE ok) AS panels, CAST(sum(CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS bubbles,
       CAST(sum(CASE WHEN ok THEN detector ELSE 0 END) AS BIGINT) AS detector_ms,
       CAST(sum(CASE WHEN ok THEN coalesce(ms, 0) ELSE 0 END) AS BIGINT) AS ocr_ms, count(*) FILTER (WHERE NOT ok) AS errors
FROM p LEFT JOIN b ON b.conv_id = p.doc_id GROUP BY project""",
    "stage_errors": "SELECT source AS project, doc_id AS panel_id FROM documents WHERE n_chars % 6 = 0",
    "benchmark_rows": f"""WITH {_RUNS_SQL}
SELECT file, mode, round_even(yolo, 1) AS yolo_ms, round_even(enc, 1) AS sam_encoder_ms, 0.0::DOUBLE AS sam_decoder_ms,
       round_even(total, 1) AS total_ms, total < 600 AS passes FROM means""",
    "benchmark_summary": f"""WITH {_RUNS_SQL}
SELECT mode, {r6('avg(round_even(total, 1))')} AS avg_total_ms, count(*) FILTER (WHERE total < 600) AS passed, count(*) AS files
FROM means WHERE file % 7 <> 0 GROUP BY mode""",
    "map_mean": f"""WITH {_RUNS_SQL},
step AS (SELECT mode, 'yolo_ms' AS key, CAST(ms AS DOUBLE) AS v FROM runs UNION ALL SELECT mode, 'total_ms', ms * 8 + k FROM runs
         UNION ALL SELECT mode, 'sam_encoder_ms', k FROM runs WHERE k % 2 = 0 UNION ALL SELECT mode, 'other', 1 FROM runs WHERE k % 2 = 1)
SELECT s.mode AS mode, key, {r6('sum(v) / any_value(n)')} AS mean FROM step s
JOIN (SELECT mode, count(*) AS n FROM runs GROUP BY mode) c ON c.mode = s.mode GROUP BY s.mode, key""",
    "ocr_report": f"""{views('bubble')},{_READ_SQL}
SELECT panel_id, count(*) AS bubbles, count(*) FILTER (WHERE clean = '') AS empty_ocr FROM read_text WHERE NOT failed GROUP BY ROLLUP (panel_id)""",
    "bubble_texts": f"""{views('bubble')},{_READ_SQL}
SELECT panel_id, bubble_id, CAST(length(clean) AS INT) AS text_len, substring(clean, 1, 80) AS text_preview FROM read_text""",
    "seam_score": f"""WITH {_GRID_SQL}
SELECT image, {r6('score')} AS score, CASE WHEN score IS NULL THEN 'OK?' WHEN score >= 38 THEN 'BAD' WHEN score >= 28 THEN 'WARN' ELSE 'OK' END AS grade
FROM scored""",
    "polygon_stats": f"""WITH {_POLY_SQL}
SELECT p_partkey, p_brand, x1, y1, x2, y2, area, n >= 3 AS use_polygon, (x2 <= x1 OR y2 <= y1) AS degenerate FROM shape""",
    "largest_polygon": f"""WITH {_POLY_SQL}
SELECT p_brand, p_partkey, area FROM shape QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY area DESC, p_partkey) = 1""",
    "fit_16_9": f"""WITH {_FIT_SQL}
SELECT page_id, w, h, mode, fit_w, fit_h, crop_w, crop_h, (w - crop_w) // 2 AS crop_x, (h - crop_h) // 2 AS crop_y,
       (1920 - fit_w) // 2 AS fit_x, (1080 - fit_h) // 2 AS fit_y FROM sized""",
    "frame_schedule": f"""
WITH clip AS (SELECT o_orderkey AS page_id, CAST(2 + o_orderkey % 4 AS DOUBLE) + 0.125::DOUBLE AS duration FROM orders),
n AS (SELECT *, greatest(1, CAST(round_even(duration * 4, 0) AS INT)) AS frames FROM clip)
SELECT page_id, duration, frames, CAST(i AS INT) AS frame,
       {r6('1 + 0.08::DOUBLE * sin(pi() * (CAST(i AS DOUBLE) / greatest(frames - 1, 1)))')} AS zoom
FROM n, range(64) AS g(i) WHERE i < frames""",
    "clip_timeline": f"""{views('page')},
several AS (SELECT source_id FROM page GROUP BY source_id HAVING count(*) > 1),
clip AS (SELECT source_id, page_id, name, 2 + page_id % 4 AS duration, page_id % 9 <> 0 AS there FROM page
         WHERE source_id IN (SELECT source_id FROM several) AND page_id % 9 <> 0)
SELECT *, row_number() OVER s AS clip_no, CAST(coalesce(sum(duration) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM clip WINDOW s AS (PARTITION BY source_id ORDER BY lower(name), name)""",
    "relative_keypoints": f"""
WITH kp AS (SELECT label AS clip, vec_id AS frame, CAST(k AS INT) AS k, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y
            FROM embeddings, range(32) AS g(k)),
ends AS (SELECT clip, min(frame) AS lo, max(frame) AS hi FROM kp GROUP BY clip),
area AS (SELECT clip, frame, greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-6::DOUBLE) AS a FROM kp GROUP BY clip, frame)
SELECT kp.clip AS clip, kp.frame AS frame, kp.k AS k, {r6('(kp.x - f.x) * sqrt(s.a / o.a) + t.x')} AS x, {r6('(kp.y - f.y) * sqrt(s.a / o.a) + t.y')} AS y
FROM kp JOIN ends e ON e.clip = kp.clip JOIN kp f ON f.clip = kp.clip AND f.frame = e.lo AND f.k = kp.k
JOIN kp t ON t.clip = kp.clip AND t.frame = e.hi AND t.k = kp.k
JOIN area o ON o.clip = kp.clip AND o.frame = e.lo JOIN area s ON s.clip = kp.clip AND s.frame = e.hi""",
    "invert_dark": f"""WITH {_BYTES_SQL}
SELECT page_id, CASE WHEN list_avg(px) < 128 THEN {_hex_sql('list_transform(px, lambda v: 255 - v)')} ELSE {_hex_sql('px')} END AS bytes FROM img""",
    "mean_luminance": f"WITH {_BYTES_SQL} SELECT page_id, {r6('list_avg(px)')} AS luminance FROM img",
    "image_seam_score": f"""WITH {_BYTES_SQL}
SELECT page_id, {r6('''(list_avg(list_transform(range(8), lambda i: abs(px[i * 8 + 4] - px[i * 8 + 5])))
       + list_avg(list_transform(range(8), lambda i: abs(px[24 + i + 1] - px[32 + i + 1])))) / 2''')} AS score FROM img""",
    "composite_on_white": f"""WITH {_BYTES_SQL},
mix AS (SELECT page_id, list_transform(range(48), lambda i: trunc(
          px[(i // 3) * 4 + i % 3 + 1]::FLOAT * (px[(i // 3) * 4 + 4]::FLOAT / 255::FLOAT)
          + 255::FLOAT * (1::FLOAT - px[(i // 3) * 4 + 4]::FLOAT / 255::FLOAT))) AS out FROM img)
SELECT page_id, 3 AS nChannels, {_hex_sql('out')} AS bytes FROM mix""",
    "crop_regions": f"""WITH {_BYTES_SQL},
win AS (SELECT page_id, px, CAST(d AS INT) AS det_id, CAST(page_id % 3 AS INT) AS wx1, CAST(2 + d AS INT) AS cw, CAST(d AS INT) AS wy1,
               CAST(d + 3 AS INT) AS ch, page_id % 10 = 0 AS empty FROM img, range(3) AS g(d))
SELECT page_id, det_id, CASE WHEN empty THEN 1 ELSE cw END AS width, CASE WHEN empty THEN 1 ELSE ch END AS height,
       CASE WHEN empty THEN '00' ELSE {_hex_sql('list_transform(range(cw * ch), lambda i: px[(wy1 + i // cw) * 8 + wx1 + i % cw + 1])')} END AS bytes
FROM win""",
    "recognize_crops": """
SELECT conv_id, turn, CASE WHEN turn = 5 THEN '' WHEN strlen(text) % 2 = 1 THEN text ELSE 'cloud ' || strlen(text) END AS text,
       CASE WHEN turn <> 5 AND strlen(text) % 2 = 1 THEN 'paddle' ELSE 'siliconflow' END AS engine FROM conversations""",
}
