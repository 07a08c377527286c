"""Small literal cases of the rules."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from foliospark.functions import names as N
from foliospark.functions.geometry import box_iou
from foliospark.operators import boxes as B
from foliospark.operators import catalog as C
from foliospark.operators import order as O
from foliospark.operators import reports as R
from foliospark.operators import suppress as S
from foliospark.operators import text as X
from foliospark.operators import tiles as T
from foliospark.operators import timeline as L


def test_tile_origins(spark):
    df = spark.createDataFrame([(500,), (640,), (1586,)], "n int")
    got = [r[0] for r in df.orderBy("n").select(T.tile_origins(F.col("n"), 640, 512)).collect()]
    assert got == [[0], [0], [0, 512, 946, 1024, 1536]]


def test_merge_tiles(spark):
    df = spark.createDataFrame([(1, 10, 10, 100, 80, .9), (1, 12, 12, 98, 78, .7), (1, 200, 200, 300, 280, .8), (1, 1, 1, 9, 9, .1)],
                               "panel_id int, x1 int, y1 int, x2 int, y2 int, score double")
    kept = S.merge_tile_boxes(df, conf=0.1, iou=0.45)
    assert sorted(r.score for r in kept.collect()) == [.8, .9]


def test_empty_boxes_count_as_one(spark):
    df = spark.createDataFrame([(1, 5, 5, 5, 9, .9), (1, 50, 50, 50, 50, .8), (1, 0, 0, 9, 9, .7)],
                               "page_id int, x1 int, y1 int, x2 int, y2 int, score double")
    for limit in (100, 2):
        assert sorted(r.score for r in S.nms(df, limit=limit).collect()) == [.7, .9]
        assert S.suppress_contained(df, limit=limit).count() == 3


def test_tensor_layouts(spark):
    single = [[0.0] * 10 for _ in range(4)] + [[0.9] * 10]
    rows6 = [[10., 20., 110., 120., .9, 0.], [50., 60., 150., 160., .95, 1.], [0.] * 5 + [1.], [0.] * 5 + [1.]]
    classes = [[0.0] * 8 for _ in range(4)] + [[.8, .1] + [0.] * 6, [.2, .95] + [0.] * 6]
    schema = "page_id int, raw array<array<float>>"
    out = B.decode_detections(spark.createDataFrame([(1, single)], schema)).collect()
    assert len(out) == 10 and out[0].score == pytest.approx(.9)
    out = B.decode_detections(spark.createDataFrame([(1, rows6)], schema), num_classes=2).collect()
    assert len(out) == 1 and out[0].score == pytest.approx(.9) and out[0].bw == pytest.approx(100) and out[0].x1 == pytest.approx(10)
    out = B.decode_detections(spark.createDataFrame([(1, classes)], schema), num_classes=2).orderBy("det_id").collect()
    assert [round(r.score, 5) for r in out[:2]] == [.8, .1]
    odd = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, single)], schema)
    with pytest.raises(Exception, match="unexpected detector output"):
        B.decode_detections(odd).collect()
    assert B.decode_detections(odd, on_unknown="drop").count() == 10


def test_iou(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15), (0, 0, 10, 10, 20, 20, 30, 30)],
                               "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    got = [r[0] for r in df.select(box_iou("a_", "b_")).collect()]
    assert got[0] == pytest.approx(25 / 175) and got[1] == 0


def test_normalize_bbox(spark):
    df = spark.createDataFrame([([100., 80., 10., 20.],), ([10.4, 5.6, 50.9, 30.1],), ([2.5, 3.5, 9., 9.],), ([1., 2.],)], "bbox array<double>")
    got = [(r.x1, r.y1, r.x2, r.y2, r.valid) for r in B.normalize_bbox(df).collect()]
    assert got == [(10, 20, 100, 80, True), (10, 6, 51, 30, True), (2, 4, 9, 9, True), (None, None, None, None, False)]


def test_bubble_orders(spark):
    df = spark.createDataFrame([("p", "b1", 0, 0, 0, 10, 10, None), ("p", "b2", 1, 0, 50, 10, 60, None)],
                               "panel_id string, bubble_id string, pos int, x1 int, y1 int, x2 int, y2 int, reading_order long")
    assert rows(O.assign_reading_order(df), "bubble_id", "reading_order") == [("b1", 1), ("b2", 2)]


def test_validation(spark):
    df = spark.createDataFrame([("ok", "speech", 1, [1, 2, 3, 4]), (None, "shout", 0, [1])],
                               "corrected_text string, type string, reading_order int, bbox array<int>")
    assert [r.errors for r in B.validate_bubbles(df).collect()] == [[], ["corrected_text", "type", "reading_order", "bbox"]]


def test_names(spark):
    df = spark.createDataFrame([("asterix_01",), ("  test project  ",), ("Мой проект",), ("   ",)], "name string")
    assert [r[0] for r in df.select(N.sanitize_name("name")).collect()] == ["asterix_01", "test_project", "Мой_проект", None]
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert df.select(N.panel_filename("a", "b", "c")).first()[0] == "001_page_002_panel_03.png"
    paths = spark.createDataFrame([("a.png",), ("x/.png",), ("d/a.tar.gz",), ("noext",), ("d\\e.JPG",)], "p string")
    assert [tuple(r) for r in paths.select(N.file_stem("p"), N.file_ext("p")).collect()] == [
        ("a", "png"), (".png", ""), ("a.tar", "gz"), ("noext", ""), ("e", "jpg")]


def test_text_lines(spark):
    df = spark.createDataFrame([(1, 0, 40., "Second line"), (1, 1, 5., "First line "), (1, 2, 6., "　")],
                               "doc_id int, pos int, y double, text string")
    assert X.merge_text_lines(df).first().text == "First line\nSecond line"
    assert X.merge_text_lines(df.where("pos < 2"), simple=True).first().text == "Second line First line"


def test_mojibake(spark):
    good = "Привет, мир"
    bad = [good.encode().decode("cp1251", "ignore"), "é".encode().decode("latin-1"), ' "plain" ', ""]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.repair_mojibake("t")).collect()]
    assert got[1:] == ["é", "plain", None]
    exact = "Где".encode().decode("cp1251")
    assert spark.createDataFrame([(exact,)], "t string").select(X.repair_mojibake("t")).first()[0] == "Где"


def test_sync_and_paths(spark):
    target = spark.createDataFrame([("p", "001.png", "t"), ("p", "002.png", "t")], "project string, name string, path string")
    source = spark.createDataFrame([("p", "003.png", "s"), ("p", "002.png", "s")], "project string, name string, path string")
    assert rows(C.sync_panels(source, target)) == rows(source)
    assert rows(C.sync_panels(source, target, mode="append"), "name", "path") == [("001.png", "t"), ("002.png", "s"), ("003.png", "s")]
    assert C.sync_panels(source, target, same_place=True) is target
    panels = spark.createDataFrame([("p", "a", "panels/002.png"), ("p", "001", "panels/001.png")], "project string, panel_id string, image_path string")
    assert rows(C.prefer_source_path(panels, source, target), "panel_id", "abs_path") == [("001", "t"), ("a", "s")]
    assert rows(C.prefer_source_path(panels, source, target, strict=True), "panel_id", "abs_path") == [("001", ""), ("a", "s")]


def test_layout_modes(spark):
    df = spark.createDataFrame([(400, 800), (1920, 1080), (3000, 1000)], "w int, h int")
    got = L.fit_16_9(df).orderBy("w").collect()
    assert [r.mode for r in got] == ["dominant_color", "smart_crop", "blurred_pillarbox"]
    assert (got[0].fit_w, got[0].fit_h, got[0].fit_x, got[0].fit_y) == (540, 1080, 690, 0)


def test_scales_and_devices(spark):
    asked = [("realesrgan", "animevideov3", 2, 2), ("realesrgan", "animevideov3", 4, 4), ("realesrgan", "anime_6B", 2, 4),
             ("realesrgan", "anime_6B", 3, 4), ("span", "span_x2_ch48", 4, 2), ("span", "span_x4_ch48", 2, 4), ("cugan", "cugan_se", 7, 2)]
    df = spark.createDataFrame(asked, "b string, m string, s int, want int")
    assert all(r[0] == r[1] for r in df.select(C.resolve_scale(F.col("b"), F.col("m"), F.col("s")), "want").collect())
    df = spark.createDataFrame([("realesrgan", -1, 0), ("realcugan", -1, -1), ("span", None, 0)], "b string, g int, want int")
    assert all(r[0] == r[1] for r in df.select(C.resolve_gpu(F.col("b"), F.col("g")), "want").collect())


def test_settings(spark):
    base = spark.createDataFrame([("split", "snap_mode", "grid"), ("split", "source_path", "x"), ("split", "rtl", "1")],
                                 "section string, key string, value string")
    patch = spark.createDataFrame([("split", "snap_mode", "invalid"), ("split", "source_path", ""), ("split", "rtl", None), ("video", "fps", "24")],
                                  "section string, key string, value string")
    got = C.layer_settings(base, patch, enums={"snap_mode": ("off", "grid", "objects")})
    assert rows(got, "section", "key", "value") == [
        ("split", "rtl", "1"), ("split", "snap_mode", "grid"), ("split", "source_path", ""), ("video", "fps", "24")]


def test_orders(spark):
    df = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 1, None), (1, "c", 2, 1), (1, "d", 3, 0)], "k int, item_id string, pos int, reading_order int")
    assert rows(O.fill_orders(df, "k"), "item_id", "reading_order") == [("a", 5), ("b", 2), ("c", 1), ("d", 3)]
    assert rows(O.normalize_orders(df, "k"), "item_id", "reading_order") == [("a", 4), ("b", 2), ("c", 1), ("d", 3)]
    for move, want in (((1, "a", 1, None), "acbd"), ((1, "c", 99, None), "bdac"), ((1, "d", None, 1), "cbad"), ((1, "c", None, -1), "cbda")):
        moved = O.move_item(O.normalize_orders(df, "k"), spark.createDataFrame([move], "k int, item_id string, to int, delta int"), "k")
        assert "".join(r.item_id for r in moved.orderBy("reading_order").collect()) == want


def test_seams_and_benchmark(spark):
    grid = spark.createDataFrame([(1, x, y, float(100 if x >= 4 else 0)) for x in range(8) for y in range(8)] + [(2, 0, 0, 1.0)],
                                 "image int, x int, y int, value double")
    assert rows(R.seam_score(grid, block=4), "image", "score") == [(1, 50.0), (2, None)]
    runs = spark.createDataFrame([("f", "fast", {"total_ms": 500.0, "yolo_ms": 1.0}), ("f", "fast", {"total_ms": 600.5})],
                                 "file string, mode string, timings map<string,double>")
    row = R.benchmark_rows(runs).first()
    assert (row.total_ms, row.yolo_ms, row.passes) == (550.2, 0.5, True)


def test_snap_edges(spark):
    schema = "page_id int, box_id int, x1 int, y1 int, x2 int, y2 int"
    boxes = spark.createDataFrame([(1, 1, 50, 50, 100, 100), (1, 2, 205, 300, 260, 400)], schema)
    pages = spark.createDataFrame([(1, 266, 500)], "page_id int, w int, h int")
    moved = spark.createDataFrame([(1, 1, 104, 3, 154, 53), (1, 2, 205, 300, 260, 400)], schema)
    assert rows(B.snap_to_edges(moved, boxes, pages), "box_id", "x1", "y1") == [(1, 104, 0), (2, 211, 300)]
