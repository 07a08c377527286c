"""Calls remembered by content: one per distinct image, none after a restart, failures as a column."""

import numpy as np
from conftest import rows
from pyspark.sql import functions as F
from test_io import flat, image_frame

from foliospark.operators import ledger as L


def pages(spark, values):
    return image_frame(spark, [flat(v) for v in values]).repartition(3)


class Calls:
    """Images that models have seen, over all worker processes: one line of a file each."""

    def __init__(self, path):
        self.path = str(path)
        open(self.path, "w").close()

    @property
    def value(self):
        with open(self.path) as f:
            return len(f.readlines())


def counting(tmp_path, fail=()):
    calls = Calls(tmp_path / f"calls-{len(list(tmp_path.glob('calls-*')))}")
    path = calls.path

    def loader():
        def model(images):
            if any(i["data"][0] in fail for i in images):
                raise RuntimeError("cannot see")
            with open(path, "a") as f:
                f.write("x\n" * len(images))
            return [[(0.0, 0.0, float(i["data"][0]), 1.0, 0.5, 1)] * 2 for i in images]
        return model

    return calls, loader


def test_one_call_per_distinct_image(spark, tmp_path):
    frame, store = pages(spark, [1, 2, 1, 3, 2, 1]), str(tmp_path / "s")
    seen, loader = counting(tmp_path)
    boxes, errors = L.detect_once(frame, loader, store=store, model="m1", wave_rows=2)
    want = sorted((k, i, float(v)) for k, v in enumerate([1, 2, 1, 3, 2, 1]) for i in (0, 1))
    assert rows(boxes, "page_id", "det_id", "x2") == want and errors.count() == 0 and seen.value == 3
    # A restart, and a larger table: only what is new is asked.
    again, loader = counting(tmp_path)
    more = pages(spark, [3, 9, 1, 9])
    boxes, _ = L.detect_once(more, loader, store=store, model="m2")
    assert rows(boxes.where("det_id = 0"), "page_id", "x2") == [(0, 3.0), (1, 9.0), (2, 1.0), (3, 9.0)] and again.value == 1
    L.detect_once(more, loader, store=store, model="m2")
    assert again.value == 1


def test_lost_wave_is_done_again(spark, tmp_path):
    frame, store = pages(spark, range(1, 9)), tmp_path / "s"
    seen, loader = counting(tmp_path)
    L.detect_once(frame, loader, store=str(store), model="m3", wave_rows=3)
    waves = sorted(store.glob("wave-*"))
    assert len(waves) == 3 and seen.value == 8
    lost = spark.read.parquet(str(waves[0])).count()
    (waves[0] / "_SUCCESS").unlink()  # as after a job that died while it wrote
    again, loader = counting(tmp_path)
    boxes, _ = L.detect_once(frame, loader, store=str(store), model="m4", wave_rows=3)
    assert again.value == lost and boxes.count() == 16


def test_failures_are_rows(spark, tmp_path):
    frame, store = pages(spark, [1, 7, 2, 7]), str(tmp_path / "s")
    seen, loader = counting(tmp_path, fail=(7,))
    boxes, errors = L.detect_once(frame, loader, store=store, model="m5")
    assert rows(errors, "page_id", "error") == [(1, "RuntimeError: cannot see"), (3, "RuntimeError: cannot see")]
    assert rows(boxes.where("det_id = 0"), "page_id") == [(0,), (2,)] and seen.value == 2
    healed, loader = counting(tmp_path)
    assert L.detect_once(frame, loader, store=store, model="m6")[1].count() == 2 and healed.value == 0
    assert L.detect_once(frame, loader, store=store, model="m6", retry_errors=True)[1].count() == 0 and healed.value == 1


def test_recognize_once(spark, tmp_path):
    frame = pages(spark, [20, 5, 20, 7]).withColumnRenamed("image", "crop").withColumn("det_id", F.lit(0))
    frame = frame.withColumn("crop", F.when(F.col("page_id") < 3, F.col("crop")))

    def local():
        def read(images):
            if any(i["data"][0] == 5 for i in images):
                raise RuntimeError("no engine")
            return [" "] * len(images)
        return read

    got = L.recognize_once(frame, local, lambda: lambda images: [f"far {i['data'][0]}" for i in images], store=str(tmp_path / "a"))
    assert rows(got, "page_id", "text", "engine", "error") == [(0, "far 20", "siliconflow", None), (1, "far 5", "siliconflow", None), (2, "far 20", "siliconflow", None), (3, "", "siliconflow", None)]
    alone = L.recognize_once(frame, local, store=str(tmp_path / "b"))
    assert rows(alone, "page_id", "text", "error") == [(0, " ", None), (1, "", "RuntimeError: no engine"), (2, " ", None), (3, "", None)]
    assert L.recognize_once(frame.limit(0), local, store=str(tmp_path / "c")).count() == 0


def test_content_hash(spark):
    same = np.zeros((2, 8, 1), np.uint8)
    frame = image_frame(spark, [same, same.reshape(8, 2, 1), same])
    got = [r.h for r in frame.select("page_id", L.content_hash("image").alias("h")).orderBy("page_id").collect()]
    assert got[0] == got[2] != got[1] and all(len(h) == 64 for h in got)
