"""Incremental intake: a store of pages with a manifest of the files they came from, so that only new or changed files are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.names import base_name
from foliospark.skew import number_rows
from foliospark.sources.pages import expand_archives, list_sources
from foliospark.sources.storage import opened

_MANIFEST = "path string, kind string, length long, modified timestamp, run long"
_PAGES = "path string, page_num int, name string, data binary, run long"


def _runs(spark: SparkSession, folder: str) -> list[int]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    storage = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in storage.listStatus(place)] if storage.exists(place) else []
    # A run counts once its manifest is complete.
    done = [n for n in names if n.startswith("run=") and storage.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """Newest entry of every file taken in: ``path, kind, length, modified, run``."""
    folders = [f"{store}/manifest/run={r}" for r in _runs(spark, f"{store}/manifest")]
    if not folders:
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(*folders)
    return rows.groupBy("path").agg(F.max_by(F.struct("kind", "length", "modified", "run"), "run").alias("m")).select("path", "m.*")


def changed_files(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Files of a folder that the store has not, or has with another length or time: only the listing is read."""
    known = manifest(spark, store).select("path", "length", "modified")
    return list_sources(spark, path).where("kind <> 'unsupported'").join(known, ["path", "length", "modified"], "left_anti")


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with opened(path) as file:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], names=["path", "content"])


def take_in(spark: SparkSession, path: str, store: str) -> int:
    """Read the new and changed files of a folder into the store; gives the number of files read.

    Pages are written first and the manifest of the run last; a run that dies is done again under its number by the next one.
    Where nothing has changed no content is read and no run made.
    """
    runs = _runs(spark, f"{store}/manifest")
    run = runs[-1] + 1 if runs else 1
    fresh = changed_files(spark, path, store)
    count = fresh.count()
    if not count:
        return 0
    # The list of the run is written first: a file that changes meanwhile differs from it and is taken in next time.
    fresh.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{store}/listed/run={run}")
    listed = spark.read.schema(_MANIFEST).parquet(f"{store}/listed/run={run}")
    # Reading the content of listed files only: the tasks open them by path, so files that are known are not opened.
    images = listed.where("kind = 'file'").select("path").mapInArrow(_bytes, "path string, content binary")
    loose = images.select("path", F.lit(None).cast("int").alias("page_num"), base_name("path").alias("name"), F.col("content").alias("data"))
    packed = expand_archives(listed.where("kind = 'archive'").select("path"), unique_names=True)
    packed = packed.select(F.col("source_id").alias("path"), "page_num", "name", "data")
    loose.unionByName(packed).withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{store}/pages/run={run}")
    listed.write.mode("overwrite").parquet(f"{store}/manifest/run={run}")
    return count


def stored_pages(spark: SparkSession, store: str) -> DataFrame:
    """Pages of the newest state of every file: ``source_id, page_num, name, data``; loose images of a folder are one numbered source."""
    runs = _runs(spark, f"{store}/manifest")
    if not runs:
        return spark.createDataFrame([], "source_id string, page_num int, name string, data binary")
    pages = spark.read.schema(_PAGES).parquet(*[f"{store}/pages/run={r}" for r in runs])
    live = pages.join(manifest(spark, store).select("path", "run"), ["path", "run"], "left_semi")
    packed = live.where("page_num is not null").select(F.col("path").alias("source_id"), "page_num", "name", "data")
    loose = live.where("page_num is null").withColumn("source_id", F.regexp_replace("path", r"/[^/]*$", ""))
    # Numbering needs names only; the bytes stay out of its shuffle.
    numbers = number_rows(loose.select("source_id", "name"), "source_id", ["name"], "_n").select("source_id", "name", F.col("_n").cast("int").alias("_n"))
    numbered = loose.join(numbers, ["source_id", "name"]).select("source_id", F.col("_n").alias("page_num"), "name", "data")
    return packed.unionByName(numbered)
