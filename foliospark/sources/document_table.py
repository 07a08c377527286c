"""A versioned table of document rows in buckets: an update writes the buckets it touches anew and leaves all others."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.documents import PART_SIZE, ROW_SCHEMA, upsert_panel

BUCKETS = 64


class ConcurrentUpdate(RuntimeError):
    """Another writer has made the version this one wanted to make; the update can be repeated."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in _names(spark, f"{path}/versions") if n.startswith("v") and n.endswith(".json")]


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict]:
    found = versions(spark, path)
    number = found[-1] if version is None else version
    return number, json.loads(spark.read.text(f"{path}/versions/v{number:09d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> int:
    fs, place = _hadoop(spark, f"{path}/versions/v{number:09d}.json")
    try:
        out = fs.create(place, False)
    except Exception as error:
        if fs.exists(place):
            raise ConcurrentUpdate(f"version {number} exists") from error
        raise
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return number


def _bucket(buckets: int) -> Column:
    # By panel, so a project with very many panels is spread too.
    return F.pmod(F.xxhash64("project", "panel_id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> dict[str, str]:
    folder = f"data/{uuid.uuid4().hex}"
    placed = rows.select("project", "pos", "slice", "panel_id", "image_path", "bubbles", _bucket(buckets).alias("bucket"))
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return {n.split("=")[1]: f"{folder}/{n}" for n in _names(rows.sparkSession, f"{path}/{folder}") if n.startswith("bucket=")}


def create_document_table(rows: DataFrame, path: str, *, buckets: int = BUCKETS) -> int:
    """Store document rows as version 1 of a new table; an existing table is an error."""
    spark = rows.sparkSession
    if versions(spark, path):
        raise ValueError(f"a table stands at {path}")
    return _commit(spark, path, 1, {"buckets": buckets, "files": _write(rows, path, buckets)})


def read_document_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Document rows of the newest or a given version."""
    return _rows(spark, path, _manifest(spark, path, version)[1]["files"].values())


def _rows(spark: SparkSession, path: str, folders) -> DataFrame:
    folders = [f"{path}/{f}" for f in folders]
    return spark.read.schema(ROW_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], ROW_SCHEMA)


def merge_document_table(updates: DataFrame, path: str, *, slice_size: int = PART_SIZE) -> tuple[int, DataFrame]:
    """(new version, updates whose panel is unknown): ``bubbles`` of panels replaced as :func:`upsert_panel` does.

    Only buckets that hold an updated panel are read and written; the new version refers to the old files of all others, and
    readers of an older version keep theirs.  The version file is made last and never replaced, so a job that dies leaves the
    table as it was and of two writers one gets :class:`ConcurrentUpdate`.  No touched bucket makes no version.
    """
    spark = updates.sparkSession
    number, manifest = _manifest(spark, path, None)
    # At most as many numbers as the table has buckets.
    touched = {str(r[0]) for r in updates.select(_bucket(manifest["buckets"])).distinct().collect()} & set(manifest["files"])
    merged, unknown = upsert_panel(_rows(spark, path, [manifest["files"][k] for k in sorted(touched)]), updates, slice_size=slice_size)
    if not touched:
        return number, unknown
    files = {**manifest["files"], **_write(merged, path, manifest["buckets"])}
    return _commit(spark, path, number + 1, {"buckets": manifest["buckets"], "files": files}), unknown


def expire_versions(spark: SparkSession, path: str, *, keep: int = 1) -> int:
    """Forget all but the newest ``keep`` versions and delete the bucket folders only they used; gives the number of folders."""
    found = versions(spark, path)
    old, kept = found[:-keep], found[-keep:]
    used = {f for v in kept for f in _manifest(spark, path, v)[1]["files"].values()}
    stale = {f for v in old for f in _manifest(spark, path, v)[1]["files"].values()} - used
    for name in [f"versions/v{v:09d}.json" for v in old] + sorted(stale):
        fs, place = _hadoop(spark, f"{path}/{name}")
        fs.delete(place, True)
    return len(stale)
