"""Model calls remembered by content: equal images go to a model once, finished calls survive a restart, failures become a column."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.models import load_once
from foliospark.session import cut_lineage

# Distinct images of one wave: what a job that dies may have to do again.
WAVE_ROWS = 100_000

BOXES = "array<struct<x1: double, y1: double, x2: double, y2: double, score: double, class_id: int>>"
Model = Callable[[pd.Series], Sequence]


def content_hash(image: Column | str) -> Column:
    """SHA-256 of an image struct: its size, layout and bytes; null for a null image."""
    column = F.col(image) if isinstance(image, str) else image
    shape = F.concat_ws(",", column["height"], column["width"], column["nChannels"], column["mode"])
    return F.when(column.isNotNull(), F.sha2(F.concat(F.encode(shape, "utf-8"), column["data"]), 256))


def ledger(spark: SparkSession, store: str, result: str) -> DataFrame:
    """Remembered calls: ``hash, result, error``; one row per hash, that of a success where there is one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    waves = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    done = [f"{store}/{w}" for w in waves if w.startswith("wave-") and files.exists(path(f"{store}/{w}/_SUCCESS"))]
    schema = f"hash string, result {result}, error string"
    if not done:
        return spark.createDataFrame([], schema)
    # Two jobs at once may both have called the model for an image.
    best = F.min_by(F.struct("result", "error"), F.struct(F.col("error").isNotNull().alias("failed"), F.coalesce("error", F.lit("")).alias("text")))
    return spark.read.schema(schema).parquet(*done).groupBy("hash").agg(best.alias("b")).select("hash", "b.*")


def _called(loader: Callable[[], Model], key: str):
    """One call per batch; where it fails, one per image, so that only images that fail get an error."""

    def tried(fn: Model, images: pd.Series) -> list[tuple]:
        try:
            found = list(fn(images))
            if len(found) != len(images):
                raise ValueError(f"{len(found)} results for {len(images)} images")
            return [(r, None) for r in found]
        except Exception as error:
            if len(images) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [tried(fn, images[i : i + 1])[0] for i in range(len(images))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load_once(key, loader)
        for batch in batches:
            results = tried(fn, batch["image"].reset_index(drop=True))
            yield pd.DataFrame({"hash": batch["hash"], "result": pd.Series([r for r, _ in results], dtype=object), "error": [e for _, e in results]})

    return run


def call_once(
    rows: DataFrame, loader: Callable[[], Model], *, store: str, result: str, keys: Sequence[str], image: str = "image",
    model: str = "model", wave_rows: int = WAVE_ROWS, retry_errors: bool = False,
) -> DataFrame:
    """``keys, hash, result, error`` of each row: what the model says of its image, asked once for equal images.

    ``loader`` gives a callable from a batch of image structs to one result (of the SQL type ``result``) each.  Answers and errors
    are kept in the folder ``store``, which belongs to one model and version; images found there are not sent again, errors only
    with ``retry_errors``.  New images are sent in waves of about ``wave_rows``; each wave is committed as a whole, so a job that
    dies has lost at most one.  A row with a null image has nulls.  ``keys`` must tell rows apart; one row stands for all of
    its hash, and only such rows' bytes move.
    """
    spark = rows.sparkSession
    slim = cut_lineage(rows.select(*keys, content_hash(image).alias("hash")))
    known = ledger(spark, store, result)
    known = known.where("error is null") if retry_errors else known
    first = slim.where("hash is not null").groupBy("hash").agg(F.min(F.struct(*keys)).alias("k"))
    todo = cut_lineage(first.join(known.select("hash"), "hash", "left_anti").select("hash", "k.*"))
    waves = -(-todo.count() // wave_rows)
    for n in range(waves):
        part = todo.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == n)
        images = rows.select(*keys, F.col(image).alias("image")).join(part, list(keys)).select("hash", "image")
        called = images.mapInPandas(_called(loader, model), f"hash string, result {result}, error string")
        called.write.parquet(f"{store}/wave-{uuid.uuid4().hex}")
    return slim.join(ledger(spark, store, result), "hash", "left").select(*keys, "hash", "result", "error")


def detect_once(pages: DataFrame, loader: Callable[[], Model], *, store: str, keys: Sequence[str] = ("page_id",), image: str = "image", **options) -> tuple[DataFrame, DataFrame]:
    """(boxes as :func:`foliospark.operators.models.detect` gives them, ``keys, error`` of the pages the detector failed on)."""
    found = call_once(pages, loader, store=store, result=BOXES, keys=keys, image=image, **options)
    boxes = found.select(*keys, F.posexplode("result").alias("det_id", "b")).select(*keys, "det_id", "b.*")
    return boxes, found.where("error is not null").select(*keys, "error")


def recognize_once(
    crops: DataFrame, local: Callable[[], Model], cloud: Callable[[], Model] | None = None, *, store: str,
    keys: Sequence[str] = ("page_id", "det_id"), crop: str = "crop", **options,
) -> DataFrame:
    """``keys, text, engine, error`` of each crop: the local engine, and for blanks and failures the cloud engine.

    Each engine has its own folder in ``store``.  ``error`` holds what the last engine asked failed with; a crop no engine could
    read has ''.
    """
    filled = F.col(crop).isNotNull() & (F.length(F.col(crop)["data"]) > 0)
    asked = crops.withColumn(crop, F.when(filled, F.col(crop)))
    near = call_once(asked, local, store=f"{store}/local", result="string", keys=keys, image=crop, model="local", **options)
    near = near.select(*keys, F.coalesce("result", F.lit("")).alias("text"), "hash", "error")
    if cloud is None:
        return near.select(*keys, "text", F.lit("paddle").alias("engine"), "error")
    blank = F.trim("text") == ""
    near = cut_lineage(near)
    rest = asked.join(near.where(blank & F.col("hash").isNotNull()).select(*keys), list(keys), "left_semi")
    far = call_once(rest, cloud, store=f"{store}/cloud", result="string", keys=keys, image=crop, model="cloud", **options)
    far = far.select(*keys, F.coalesce("result", F.lit("")).alias("far"), F.col("error").alias("far_error"))
    merged = near.join(far, list(keys), "left")
    return merged.select(
        *keys, F.when(blank, F.coalesce("far", F.lit(""))).otherwise(F.col("text")).alias("text"),
        F.when(blank, F.lit("siliconflow")).otherwise(F.lit("paddle")).alias("engine"), F.when(blank, F.col("far_error")).alias("error"))
