"""Jobs on the Spark ``image`` struct: Arrow batches, numpy inside, no other imaging library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.skew import in_parts

IMAGE_TYPE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

# OpenCV type codes of 8-bit images by channel count, and luminance weights (blue, green, red).
CV_MODE = {1: 0, 3: 16, 4: 24}
LUMA_BGR = np.array([0.114, 0.587, 0.299])

# Crop windows carried by one copy of a page image.
WINDOWS_PER_IMAGE = 1_000
# Crops handed back at a time.
CROPS_PER_BATCH = 256


def pixels(row) -> np.ndarray:
    """H×W×C array of an image row (BGR or BGRA order)."""
    return np.frombuffer(row.data, np.uint8).reshape(int(row.height), int(row.width), int(row.nChannels))


def image_dict(origin: str, array: np.ndarray) -> dict:
    if array.ndim == 2:
        array = array[:, :, None]
    h, w, c = array.shape
    return {"origin": origin, "height": h, "width": w, "nChannels": c, "mode": CV_MODE[c],
            "data": np.ascontiguousarray(array, dtype=np.uint8).tobytes()}


def luminance(array: np.ndarray) -> np.ndarray:
    if array.shape[2] == 1:
        return array[:, :, 0].astype(np.float64)
    return np.rint(array[:, :, :3] @ LUMA_BGR)


def readable(row) -> bool:
    """False for a null image and for the rows Spark keeps for unreadable files."""
    return row.data is not None and row.height == row.height and bool(row.height) and row.height > 0


def _rewrite(transform):
    """Arrow UDF image → image; unreadable images (height below 1) become null."""

    @F.pandas_udf(IMAGE_TYPE)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["origin", "height", "width", "nChannels", "mode", "data"]
        for batch in batches:
            rows = [image_dict(r.origin, transform(pixels(r))) if readable(r)
                    else dict.fromkeys(fields) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=fields)

    return run


def composite_on_white(image: Column | str, composite: bool = True) -> Column:
    """Three BGR channels: alpha blended over white (truncated), or dropped; gray repeated."""

    def flat(a: np.ndarray) -> np.ndarray:
        if a.shape[2] == 1:
            return np.repeat(a, 3, axis=2)
        if a.shape[2] == 4 and composite:
            alpha = a[:, :, 3:4].astype(np.float32) / np.float32(255)
            return (a[:, :, :3].astype(np.float32) * alpha + np.float32(255) * (1 - alpha)).astype(np.uint8)
        return a[:, :, :3]

    return _rewrite(flat)(image)


def invert_dark(image: Column | str, mode: str = "auto", threshold: float = 128) -> Column:
    """Inverted image when its mean luminance is below the threshold (``auto``), ``always`` or ``never``."""
    if mode not in ("auto", "always", "never"):
        raise ValueError("mode: auto | always | never")

    def invert(a: np.ndarray) -> np.ndarray:
        dark = mode == "always" or (mode == "auto" and luminance(a).mean() < threshold)
        return 255 - a if dark else a

    return _rewrite(invert)(image)


def mean_luminance(image: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([float(luminance(pixels(r)).mean()) if readable(r) else None for r in batch.itertuples(index=False)],
                            dtype="object").astype("Float64")

    return run(image)


def image_seam_score(image: Column | str, block: int = 64) -> Column:
    """Mean jump across block boundaries; null for images below two blocks."""

    def score(a: np.ndarray) -> float | None:
        gray = luminance(a)
        h, w = gray.shape
        if h < 2 * block or w < 2 * block:
            return None
        xs, ys = np.arange(block, w, block), np.arange(block, h, block)
        across = np.abs(gray[:, xs - 1] - gray[:, xs]).mean(axis=0)
        down = np.abs(gray[ys - 1, :] - gray[ys, :]).mean(axis=1)
        return float(np.concatenate([across, down]).mean())

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([score(pixels(r)) if readable(r) else None for r in batch.itertuples(index=False)], dtype="object").astype("Float64")

    return run(image)


def crop_regions(
    pages: DataFrame, windows: DataFrame, *, page: str = "page_id", id: str = "det_id", image: str = "image",
    per_image: int = WINDOWS_PER_IMAGE,
) -> DataFrame:
    """One ``crop`` row per window (``wx1..wy2``; ``empty`` gives a 1×1 black placeholder).

    Windows are gathered per page first, so image bytes meet the shuffle once per page, and pages
    with very many windows once per ``per_image`` of them.  Null and unreadable images give no crop.
    """
    empty = F.col("empty") if "empty" in windows.columns else F.lit(False)
    slim = windows.select(page, id, "wx1", "wy1", "wx2", "wy2", empty.alias("empty"))
    parts = in_parts(slim, page, [id], "_part", size=per_image)
    box = F.struct(id, "wx1", "wy1", "wx2", "wy2", "empty")
    lists = parts.groupBy(page, "_part").agg(F.collect_list(box).alias("_w"))
    shown = pages.select(page, F.col(image).alias("_image")).where("_image.data is not null and _image.height > 0")
    joined = lists.join(shown, page)
    types = {f.name: f.dataType.simpleString() for f in windows.schema}
    schema = f"{page} {types[page]}, {id} {types[id]}, crop {IMAGE_TYPE}"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for key, boxes, img in zip(batch[page], batch["_w"], batch["_image"]):
                array = np.frombuffer(img["data"], np.uint8).reshape(img["height"], img["width"], img["nChannels"])
                for b in boxes:
                    part = (np.zeros((1, 1, array.shape[2]), np.uint8) if b["empty"]
                            else array[b["wy1"]:b["wy2"], b["wx1"]:b["wx2"]])
                    if part.size:
                        out.append({page: key, id: b[id], "crop": image_dict(img["origin"], part)})
                if len(out) >= CROPS_PER_BATCH:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)

    return joined.mapInPandas(cut, schema)
