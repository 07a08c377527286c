"""16:9 geometry, frame schedules, clip timelines and relative keypoints."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.skew import GROUP_LIMIT, names, prefix_scan

# Target frame, and the tolerance within which a panel is cropped to it.
FRAME_W, FRAME_H = 1920, 1080
CROP_TOLERANCE = 0.2


def _whole(value: Column) -> Column:
    return value.cast("long")


def fit_16_9(df: DataFrame, *, mode: str = "auto", width: str = "w", height: str = "h",
             frame: tuple[int, int] = (FRAME_W, FRAME_H)) -> DataFrame:
    """Layout mode, contained size and offset, and centre-crop window of each image in the frame."""
    tw, th = frame
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    ratio = w / F.greatest(h, F.lit(1.0))
    if mode == "auto":
        picked = (F.when(F.abs(ratio - F.lit(16 / 9)) < CROP_TOLERANCE, F.lit("smart_crop"))
                  .when(ratio < 1.0, F.lit("dominant_color")).otherwise(F.lit("blurred_pillarbox")))
    else:
        picked = F.lit(mode)
    scale = F.least(F.lit(float(tw)) / w, F.lit(float(th)) / h)
    target = tw / th
    wide = w / h > target
    crop_w = F.when(wide, _whole(h * target)).otherwise(_whole(w))
    crop_h = F.when(wide, _whole(h)).otherwise(_whole(w / target))
    return df.withColumns({
        "mode": picked,
        "fit_w": F.greatest(F.lit(1), _whole(w * scale)), "fit_h": F.greatest(F.lit(1), _whole(h * scale)),
        "crop_w": crop_w, "crop_h": crop_h,
        "crop_x": F.floor((_whole(w) - crop_w) / 2).cast("long"), "crop_y": F.floor((_whole(h) - crop_h) / 2).cast("long"),
    }).withColumns({
        "fit_x": F.floor((F.lit(tw) - F.col("fit_w")) / 2).cast("long"),
        "fit_y": F.floor((F.lit(th) - F.col("fit_h")) / 2).cast("long"),
    })


def frame_schedule(clips: DataFrame, *, duration: str = "duration", fps: int = 24, intensity: float = 0.3) -> DataFrame:
    """One row per frame with its zoom factor: a single sine pulse over the clip."""
    n = F.greatest(F.lit(1), F.bround(F.col(duration) * F.lit(fps)).cast("int"))
    pulse = 1.0 + 0.05 + 0.1 * intensity - 1.0
    rows = clips.withColumn("frames", n).withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    t = F.col("frame") / F.greatest(F.col("frames") - 1, F.lit(1))
    return rows.withColumn("zoom", F.lit(1.0) + F.lit(pulse) * F.sin(F.lit(math.pi) * t))


def clip_timeline(
    clips: DataFrame, *, by: str | Sequence[str] = "source_id", name: str = "name", duration: str = "duration",
    exists: str | None = None, limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Start of each clip when the clips of a source are joined in name order.

    Sources with a single clip are not joined; clips whose file is absent take no place.
    """
    by = names(by)
    several = clips.groupBy(*by).agg(F.count(F.lit(1)).alias("_clips")).where("_clips > 1").select(*by)
    present = clips.where(F.col(exists)) if exists else clips
    order = [F.lower(name), F.col(name)]
    timed = prefix_scan(present.join(several, by, "left_semi"), by, order, rank="clip_no",
                        totals={"start": F.col(duration)}, limit=limit)
    return timed


def _extent_area(points: Column) -> Column:
    def extent(axis: str) -> Column:
        values = F.transform(points, lambda p: p.getField(axis))
        return F.array_max(values) - F.array_min(values)

    return F.greatest(extent("x") * extent("y"), F.lit(1e-6))


def relative_keypoints(
    frames: DataFrame, source: DataFrame, *, clip: str = "clip", frame: str = "frame", points: str = "points"
) -> DataFrame:
    """Driving keypoints moved onto the source: (kp - first) · sqrt(area_source / area_first) + source."""
    first = frames.groupBy(clip).agg(F.min_by(points, frame).alias("_first"))
    base = first.join(source.select(clip, F.col(points).alias("_source")), clip)
    base = base.withColumn("_scale", F.sqrt(_extent_area(F.col("_source")) / _extent_area(F.col("_first"))))
    joined = frames.join(base, clip)

    def moved(p: Column, i: Column) -> Column:
        first_p, source_p = F.get(F.col("_first"), i), F.get(F.col("_source"), i)
        return F.struct(*[((p.getField(a) - first_p.getField(a)) * F.col("_scale") + source_p.getField(a)).alias(a)
                          for a in ("x", "y")])

    return joined.withColumn(points, F.transform(points, moved)).select(*frames.columns)
