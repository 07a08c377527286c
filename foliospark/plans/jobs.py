"""The three end-to-end jobs: pages to panels, panels to bubble documents, panels to a clip plan.

Model output is cut from its lineage as soon as it exists, so no page is shown to a model twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.names import file_stem, panel_filename
from foliospark.operators.boxes import filter_min_area, padded_window, rescale_clip
from foliospark.operators.catalog import resolve_gpu, resolve_scale
from foliospark.operators.documents import build_documents
from foliospark.operators.images import composite_on_white, crop_regions
from foliospark.operators.models import detect, recognize
from foliospark.operators.order import cluster_rows, global_order, number_rows, panel_ids, unique_ids
from foliospark.operators.suppress import merge_tile_boxes, nms, suppress_contained
from foliospark.operators.tiles import plan_tiles, translate_tiles
from foliospark.operators.timeline import clip_timeline, fit_16_9
from foliospark.session import cut_lineage


def split_pages(
    pages: DataFrame, loader: Callable, *, conf: float = 0.35, iou: float = 0.45, contained: float = 0.7,
    input_size: int = 640, class_id: int = 0, reading_order: bool = True, rtl: bool = False, detector: str = "comic",
) -> DataFrame:
    """Named panels of ``pages`` (``source_id, page_num, name, image``); the detector answers in model coordinates.

    Without ``reading_order`` the panels of a page count by score.
    """
    keyed = pages.withColumn("page_id", F.struct("source_id", "page_num"))
    sizes = keyed.select("page_id", "source_id", "name", F.col("image.width").alias("w"), F.col("image.height").alias("h"))
    found = cut_lineage(detect(pages.where("image IS NOT NULL"), loader, keys=["source_id", "page_num"], model=detector)
                        .withColumn("page_id", F.struct("source_id", "page_num")).drop("source_id", "page_num"))
    strong = nms(found.where(F.col("class_id") == class_id), conf=conf, iou=iou)
    kept = suppress_contained(rescale_clip(strong, sizes, input_size=input_size), overlap=contained)
    if reading_order:
        read = cluster_rows(kept, rtl=rtl, tie=["det_id"]).drop("row_no")
    else:
        read = number_rows(kept, "page_id", [-F.col("score"), "x1", "y1", "x2", "y2"], "reading_order")
    numbered = panel_ids(global_order(read, sizes.select("page_id", "source_id", "name")))
    return numbered.select(
        "source_id", "page_num", "panel_id", "reading_order", "global_order", "x1", "y1", "x2", "y2",
        F.col("score").alias("confidence"), panel_filename("global_order", "page_num", "panel_num").alias("file_name"))


def panels_to_documents(
    panels: DataFrame, loader: Callable, local: Callable, cloud: Callable | None = None, *, conf: float = 0.12,
    iou: float = 0.45, min_area: int = 32, padding: int = 12, tile: int = 640, overlap: float = 0.2, class_id: int = 1,
    detector: str = "manga",
) -> DataFrame:
    """Project documents of panel images (``project, name, image``): tiled detection, reading order, texts.

    The detector sees the tiles and answers in tile pixels; ``local`` and ``cloud`` read the bubble crops.
    """
    listed = number_rows(panels.select("project", "name"), "project", [F.lower("name"), "name"], "pos")
    ids = unique_ids(listed.withColumn("stem", file_stem("name")), "project").select("project", "name", "pos", "panel_id")
    keyed = (panels.where("image IS NOT NULL").join(ids, ["project", "name"])
             .select("project", "pos", F.struct("project", "panel_id").alias("key"), "name", composite_on_white("image").alias("image")))
    sizes = keyed.select("key", F.col("image.width").alias("w"), F.col("image.height").alias("h"))

    tiles = plan_tiles(sizes, tile=tile, overlap=overlap, page="key").selectExpr(
        "key", "tile_no", "tx1 AS wx1", "ty1 AS wy1", "tx2 AS wx2", "ty2 AS wy2")
    views = crop_regions(_flat(keyed), _flat(tiles), page="panel", id="tile_no")
    found = cut_lineage(detect(views.withColumnRenamed("crop", "image"), loader, keys=["panel", "tile_no"], model=detector))
    tile_boxes = nms(found.where(F.col("class_id") == class_id), conf=conf, iou=iou, by=["panel", "tile_no"])
    moved = translate_tiles(tile_boxes, _flat(sizes), tile=tile, overlap=overlap, page="panel")
    merged = filter_min_area(merge_tile_boxes(moved, conf=conf, iou=iou, by="panel"), min_area)
    whole = merged.select("panel", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    read = cluster_rows(whole, by="panel", tie=["y1", "x1", "x2", "y2"]).drop("row_no")

    crops = crop_regions(_flat(keyed), padded_window(read, _flat(sizes), padding=padding, page="panel"), page="panel", id="reading_order")
    texts = cut_lineage(recognize(crops, local, cloud, keys=["panel", "reading_order"]))
    bubbles = read.join(texts, ["panel", "reading_order"])
    names = _flat(keyed.select("key", "project", "pos", "name")).select(
        "project", F.col("panel").alias("panel_id"), F.concat(F.lit("panels/"), "name").alias("image_path"), "pos")
    named = bubbles.select(
        F.col("panel").alias("panel_id"), F.concat(_short("panel"), F.lit("_b"), F.col("reading_order").cast("string")).alias("bubble_id"),
        "reading_order", "x1", "y1", "x2", "y2", F.col("text").alias("raw_text"), F.col("text").alias("corrected_text"),
        F.lit("speech").alias("type"))
    docs = build_documents(names, named)
    return docs.withColumn("panels", F.transform(
        "panels", lambda p: p.withField("panel_id", F.substring_index(p.getField("panel_id"), _SEP, -1))))


# Panels of different projects may share an id, so both travel as one text key.
_SEP = "\x1f"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(_SEP, "key.project", "key.panel_id").alias("panel"), *[c for c in df.columns if c != "key"])


def _short(column: str):
    return F.substring_index(column, _SEP, -1)


def clip_plan(
    panels: DataFrame, *, backend: str = "realesrgan", model: str = "animevideov3", scale: int = 2, gpu: int = 0,
    duration: float = 3.0,
) -> DataFrame:
    """Upscale settings, 16:9 layout and place in the joined clip of each panel (``source_id, name, w, h``)."""
    b, m = F.lit(backend), F.lit(model)
    sized = panels.withColumns({"scale": resolve_scale(b, m, F.lit(scale)), "gpu": resolve_gpu(b, F.lit(gpu))})
    sized = sized.withColumns({"w": F.col("w") * F.col("scale"), "h": F.col("h") * F.col("scale"), "duration": F.lit(duration)})
    return clip_timeline(fit_16_9(sized))
