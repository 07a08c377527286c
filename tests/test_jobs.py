"""End-to-end jobs with stand-in models."""

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from foliospark.operators import images as I
from foliospark.plans.jobs import clip_plan, panels_to_documents, split_pages


def pages_frame(spark, sizes):
    data = [(s, n, f"{n}.png", tuple(I.image_dict("m", np.full((h, w, 3), 200, np.uint8)).values())) for s, n, w, h in sizes]
    return spark.createDataFrame(data, f"source_id string, page_num int, name string, image {I.IMAGE_TYPE}")


def page_model():
    # Nested, so that workers get it by value. Two panels side by side, a weaker copy of the first, one below, one of another class, one too weak.
    boxes = [(320, 0, 640, 300, .9, 0), (0, 0, 310, 300, .8, 0), (2, 2, 310, 300, .5, 0), (0, 320, 640, 640, .7, 0),
             (0, 0, 640, 640, .99, 1), (0, 0, 9, 9, .35, 0)]
    return lambda: lambda batch: [boxes if i["width"] > 100 else [] for i in batch["image"]]


def test_split_pages(spark):
    pages = pages_frame(spark, [("a", 1, 320, 640), ("a", 2, 50, 50), ("a", 3, 640, 640), ("b", 1, 640, 640)])
    out = split_pages(pages, page_model())
    names = {s: [r.file_name for r in out.where(F.col("source_id") == s).orderBy("global_order").collect()] for s in "ab"}
    assert names["a"] == ["001_page_001_panel_01.png", "002_page_001_panel_02.png", "003_page_001_panel_03.png",
                          "004_page_003_panel_01.png", "005_page_003_panel_02.png", "006_page_003_panel_03.png"]
    first = out.where("source_id = 'a' AND page_num = 1").orderBy("reading_order").collect()
    assert [(r.panel_id, r.x1, r.y1, r.x2, r.y2) for r in first] == [
        ("p001", 0, 0, 155, 300), ("p002", 160, 0, 320, 300), ("p003", 0, 320, 320, 640)]
    manga = split_pages(pages, page_model(), rtl=True).where("source_id = 'b'").orderBy("reading_order").collect()
    assert [r.x1 for r in manga] == [320, 0, 0]
    by_score = split_pages(pages, page_model(), reading_order=False).where("source_id = 'b'").orderBy("reading_order").collect()
    assert [round(r.confidence, 2) for r in by_score] == [.9, .8, .7]


def tile_model():
    # One bubble at a fixed place of every tile, which neighbouring tiles see shifted, and a speck.
    boxes = [(20, 30, 60, 70, .9, 1), (1, 1, 3, 3, .8, 1), (5, 5, 90, 90, .9, 0)]
    return lambda: lambda batch: [boxes for _ in batch["image"]]


def test_panels_to_documents(spark):
    pages = pages_frame(spark, [("a", 1, 100, 100), ("b", 1, 180, 100), ("a", 2, 10, 10)])
    panels = pages.select(F.col("source_id").alias("project"), "name", "image")

    def local():
        return lambda crops: [" " if c["width"] > 60 else f"{c['width']}x{c['height']}" for c in crops]

    def cloud():
        return lambda crops: ["far"] * len(crops)

    docs = panels_to_documents(panels, tile_model(), local, cloud, tile=100, overlap=0.2, padding=5).orderBy("project").collect()
    assert [d.project for d in docs] == ["a", "b"]
    a, b = docs
    assert [p.panel_id for p in a.panels] == ["1", "2"] and a.panels[0].image_path == "panels/1.png"
    assert [(x.bubble_id, x.bbox, x.raw_text) for x in a.panels[0].bubbles] == [("1_b1", [20, 30, 60, 70], "50x50")]
    # Tile origins 0, 80 and 160: three bubbles in one row.
    assert [x.bbox[0] for x in b.panels[0].bubbles] == [20, 100, 180]
    assert [x.reading_order for x in b.panels[0].bubbles] == [1, 2, 3]


def test_clip_plan(spark):
    panels = spark.createDataFrame([("s", "b.png", 400, 800), ("s", "A.png", 1920, 1080), ("t", "x.png", 1, 1)], "source_id string, name string, w int, h int")
    got = clip_plan(panels, model="anime_6B", scale=2, gpu=-1)
    assert rows(got, "name", "clip_no", "start", "mode", "scale", "gpu") == [
        ("A.png", 1, 0.0, "smart_crop", 4, 0), ("b.png", 2, 3.0, "dominant_color", 4, 0)]
