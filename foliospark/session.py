"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "foliospark") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's session is used as it is."""
    partitions = "8" if cpus == "*" else str(max(1, int(cpus)))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a local session may do without one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names, so lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Like :func:`cut_lineage`, as compressed columns: for wide or many rows, of which a checkpoint keeps every byte."""
    path = f"{folder or checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder beside the checkpoints for what a chain of steps stores; it goes with the chain, so results are not kept there."""
    path = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        dropped(spark, path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside drop their shuffle files as soon as they end, not when the driver collects its garbage.

    For chains of steps that each end in :func:`cut_lineage` or :func:`stored`; a result that is read after the chain and is
    not one of these belongs outside, since running it again would shuffle again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
