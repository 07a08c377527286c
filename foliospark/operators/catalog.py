"""Listings, file presence, settings and other catalogue joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.names import (
    PANEL_EXTENSIONS,
    base_name,
    canonical_engine,
    file_ext,
    file_stem,
    source_kind,
)
from foliospark.skew import broadcast_if_small, names, number_rows


def list_panels(files: DataFrame, *, folder: str = "folder", name: str = "name") -> DataFrame:
    """Panel images of each folder in case-insensitive name order, with ``pos``."""
    return number_rows(files.where(file_ext(name).isin(*PANEL_EXTENSIONS)), folder, [F.lower(name), name], "pos")


def list_projects(folders: DataFrame, *, query: str = "", name: str = "name") -> DataFrame:
    """Distinct, visible project names containing ``query`` (any case), in case-insensitive order."""
    shown = folders.select(name).where(~F.startswith(F.col(name), F.lit("."))).distinct()
    wanted = query.strip().lower()
    if wanted:
        shown = shown.where(F.contains(F.lower(name), F.lit(wanted)))
    return shown.orderBy(F.lower(name), name)


def read_listing(files: DataFrame, *, path: str = "path", is_dir: Column | None = None) -> DataFrame:
    """Add ``source_kind``: file, archive, folder, or unsupported rows to set aside."""
    return files.withColumn("source_kind", source_kind(path, is_dir))


def prefer_source_path(
    panels: DataFrame, source: DataFrame, project: DataFrame, *, strict: bool = False
) -> DataFrame:
    """Path of each panel: current folder by file name, else by stem = panel id, else the project copy.

    ``panels`` has ``project, panel_id, image_path``; ``source`` and ``project`` list ``project, name, path``.
    ``strict`` leaves the project copy out; a panel found nowhere gets ''.
    """
    direct = source.groupBy("project", F.col("name").alias("_name")).agg(F.min("path").alias("_direct"))
    images = source.where(file_ext("name").isin(*PANEL_EXTENSIONS))
    stems = (images.groupBy("project", file_stem("name").alias("panel_id"))
             .agg(F.min_by("path", F.struct(F.lower("name"), "name")).alias("_by_stem")))
    out = panels.withColumn("_name", base_name("image_path")).join(direct, ["project", "_name"], "left")
    out = out.join(stems, ["project", "panel_id"], "left")
    choices = [F.col("_direct"), F.col("_by_stem")]
    if not strict:
        copies = project.groupBy("project", F.col("name").alias("_name")).agg(F.min("path").alias("_copy"))
        out = out.join(copies, ["project", "_name"], "left")
        choices.append(F.col("_copy"))
    return out.withColumn("abs_path", F.coalesce(*choices, F.lit(""))).select(*panels.columns, "abs_path")


def missing_artifacts(required: DataFrame, present: DataFrame, *, item: str = "item") -> DataFrame:
    """Required rows whose item is not present."""
    return required.join(present.select(item), item, "left_anti").select(*required.columns)


def artifact_status(required: DataFrame, present: DataFrame, *, owner: str | Sequence[str], item: str = "item") -> DataFrame:
    """Per owner: required and missing counts, and ``installed`` when nothing is missing."""
    owner = names(owner)
    known = present.select(item).distinct().withColumn("_here", F.lit(True))
    flagged = required.join(known, item, "left")
    absent = F.count_if(F.col("_here").isNull())
    return flagged.groupBy(*owner).agg(F.count(F.lit(1)).alias("n_required"), absent.alias("n_missing"),
                                       (absent == 0).alias("installed"))


def installed_only(
    cases: DataFrame, status: DataFrame, *, key: str | Sequence[str] = "backend", only: Sequence[str] | None = None
) -> DataFrame:
    """Cases whose backend is installed and, when given, in ``only``."""
    key = names(key)
    if only:
        cases = cases.where(F.col(key[0]).isin(*only))
    return cases.join(broadcast_if_small(status.where("installed").select(*key).distinct()), key, "left_semi")


# Upscale cases (backend, model, scale) and the GPU and tile settings they are run with.
UPSCALE_CASES = (
    ("realesrgan", "animevideov3", 2),
    ("realesrgan", "animevideov3", 4),
    ("realesrgan", "anime_6B", 4),
    ("realcugan", "cugan_se", 2),
    ("realcugan", "cugan_se", 4),
    ("span", "span_x2_ch48", 2),
    ("span", "span_x4_ch48", 4),
)
UPSCALE_GPUS = (0, -1)
UPSCALE_TILES = (0, 128)


def case_matrix(
    rows: DataFrame, *, gpus: Sequence[int] = UPSCALE_GPUS, tiles: Sequence[int] = UPSCALE_TILES,
    cases: Sequence[tuple[str, str, int]] = UPSCALE_CASES,
) -> DataFrame:
    """Every row with every (gpu, tile, backend, model, scale): the fixed list is unfolded in place, no join."""
    combos = [F.struct(F.lit(g).alias("gpu"), F.lit(t).alias("tile"), F.lit(b).alias("backend"), F.lit(m).alias("model"),
                       F.lit(s).alias("scale")) for g in gpus for t in tiles for b, m, s in cases]
    return rows.withColumn("_case", F.explode(F.array(*combos))).select(*rows.columns, "_case.*")


def detector_matrix(pages: DataFrame, detectors: Sequence[str] = ("comic", "manga")) -> DataFrame:
    """Every page with every detector."""
    return pages.withColumn("detector", F.explode(F.array(*[F.lit(d) for d in detectors])))


def lookup_settings(
    df: DataFrame, dim: DataFrame, *, key: str | Sequence[str], default: Mapping[str, object] | None = None,
    unknown: str = "default",
) -> DataFrame:
    """Attach the columns of ``dim`` by key; unknown keys get ``default`` (null without one), or with ``unknown="error"`` fail.

    Null values of known keys stay null.
    """
    if unknown not in ("default", "error"):
        raise ValueError("unknown: default | error")
    key = names(key)
    out = df.join(broadcast_if_small(dim.withColumn("_known", F.lit(True))), key, "left")
    if unknown == "error":
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
        checked = F.coalesce("_known", F.raise_error(F.concat(F.lit("unknown key: "), name)).cast("boolean"))
        return out.where(checked).drop("_known")
    if default:
        out = out.withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(F.lit(v)) for c, v in default.items()})
    return out.drop("_known")


# Detector specifications (id, number of classes, panel class).
DETECTOR_SPECS = (("comic", 1, 0), ("manga", 2, 0))


def detector_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DETECTOR_SPECS), "detector string, num_classes int, panel_class_id int")


def lookup_detector(df: DataFrame, *, raw: str = "detector") -> DataFrame:
    """Detector specification by id, unknown ids falling back to the default detector."""
    return lookup_settings(df.withColumn("detector", canonical_engine(raw, "detector")), detector_specs(df.sparkSession),
                           key="detector")


# Scale rules per backend and model.
X4_ONLY_MODEL = "anime_6B"
SPAN_SCALES = {"span_x2_ch48": 2, "span_x4_ch48": 4}
MODEL_SCALES = {
    ("realesrgan", "animevideov3"): (2, 4),
    ("realesrgan", "anime_6B"): (4,),
    ("realcugan", "cugan_se"): (1, 2, 3, 4),
    ("span", "span_x2_ch48"): (2,),
    ("span", "span_x4_ch48"): (4,),
}


def resolve_scale(backend: Column, model: Column, scale: Column) -> Column:
    """Requested scale put within what the backend and model allow."""
    b = canonical_engine(backend, "upscale")
    esrgan = F.when(model == X4_ONLY_MODEL, F.lit(4)).when(scale.isin(2, 3, 4), scale).otherwise(F.lit(2))
    span = F.when(scale == 4, F.lit(4)).otherwise(F.lit(2))
    for name, fixed in SPAN_SCALES.items():
        span = F.when(model == name, F.lit(fixed)).otherwise(span)
    cugan = F.when(scale.isin(1, 2, 3, 4), scale).otherwise(F.lit(2))
    return F.when(b == "realesrgan", esrgan).when(b == "span", span).otherwise(cugan)


def allowed_scales(backend: Column, model: Column) -> Column:
    """Scales offered for a backend and model."""
    b = canonical_engine(backend, "upscale")
    out = F.when(b == "realcugan", F.array(*[F.lit(s) for s in (1, 2, 3, 4)])).otherwise(F.array(F.lit(2), F.lit(4)))
    for (name, kind), scales in MODEL_SCALES.items():
        out = F.when((b == name) & (model == kind), F.array(*[F.lit(s) for s in scales])).otherwise(out)
    return out


def resolve_gpu(backend: Column, gpu: Column) -> Column:
    """Device id; the one backend without a CPU mode always runs on device 0."""
    return F.when(canonical_engine(backend, "upscale") == "realesrgan", F.lit(0)).otherwise(F.coalesce(gpu, F.lit(0)))


def attach_results(
    pages: DataFrame, results: DataFrame, *, on: Sequence[str] = ("source_id", "page_num", "name")
) -> DataFrame:
    """Bring results that arrived in any order back to their pages."""
    return pages.join(results, list(on))


def layer_settings(
    base: DataFrame, patch: DataFrame, *, enums: Mapping[str, Sequence[str]] | None = None,
    key: Sequence[str] = ("section", "key"), value: str = "value",
) -> DataFrame:
    """Overlay wins per key; a null overlay keeps the base, '' clears, enum keys only take allowed values.

    Every key of the base stays, also one whose value is null.
    """
    key = list(key)
    layered = (base.select(*key, F.col(value).alias("_base"), F.lit(True).alias("_in_base"))
               .join(patch.select(*key, F.col(value).alias("_patch")), key, "full_outer"))
    allowed = F.col("_patch").isNotNull()
    for field, values in (enums or {}).items():
        allowed = allowed & ((F.col(key[-1]) != field) | F.col("_patch").isin(*values))
    merged = F.when(allowed, F.col("_patch")).otherwise(F.col("_base"))
    return layered.withColumn(value, merged).where(F.col(value).isNotNull() | F.col("_in_base")).select(*key, value)


def sync_panels(
    source: DataFrame, target: DataFrame, *, mode: str = "replace", key: Sequence[str] = ("project", "name"),
    same_place: bool = False, extensions: Sequence[str] | None = None,
) -> DataFrame:
    """New content of the target: exactly the source (``replace``), or the source over the old (``append``).

    ``extensions`` (lower case, without dot) restricts what is taken from the source to names that end in one of them.
    """
    if extensions is not None:
        source = source.where(F.lower(F.regexp_extract(key[-1], r"\.([^.]+)$", 1)).isin(*extensions))
    if same_place:
        return target
    if mode == "replace":
        return source
    if mode != "append":
        raise ValueError("mode: append | replace")
    return source.unionByName(target.join(source.select(*key), list(key), "left_anti").select(*source.columns))


def sync_diff(source: DataFrame, target: DataFrame, *, key: Sequence[str] = ("project", "name")) -> DataFrame:
    """Per name: ``add`` (source only), ``keep`` (both) or ``delete`` (target only), in one shuffle."""
    key = list(key)
    a = source.select(*key).distinct().withColumn("_s", F.lit(1))
    b = target.select(*key).distinct().withColumn("_t", F.lit(1))
    action = (F.when(F.col("_t").isNull(), F.lit("add")).when(F.col("_s").isNull(), F.lit("delete")).otherwise(F.lit("keep")))
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


