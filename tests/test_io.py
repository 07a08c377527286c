"""Readers, sinks, image jobs, models and streams on small files."""

import base64
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from foliospark.operators import documents as D
from foliospark.operators import images as I
from foliospark.operators.models import detect, recognize
from foliospark.operators.suppress import nms
from foliospark.sources import documents as docs_io
from foliospark.sources import intake
from foliospark.sources import pages as P
from foliospark.sources.requests import read_requests
from foliospark.sources.sinks import write_panel_manifest, write_report_csv
from foliospark.streaming.requests import stream_requests, write_batches


def png(array):
    """Uncompressed-filter PNG of an H×W×C array in RGB(A) order."""
    h, w, c = array.shape
    raw = b"".join(b"\0" + array[y].tobytes() for y in range(h))

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def flat(value, size=8, channels=3):
    return np.full((size, size, channels), value, np.uint8)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "pages"
    root.mkdir()
    (root / "b.PNG").write_bytes(png(flat(20)))
    (root / "a.png").write_bytes(png(flat(240)))
    (root / "c.jpg").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    (root / "sub").mkdir()
    (root / "sub" / "d.png").write_bytes(png(flat(1)))
    with zipfile.ZipFile(root / "book.cbz", "w") as z:
        for name in ("x/2.png", "1.png", "y/2.png", "readme.md", "x/", "2_2.png"):
            z.writestr(name, b"" if name.endswith("/") else name.encode())
    return str(root)


def test_scan_folder(spark, folder):
    pages = P.scan_page_folder(spark, folder)
    assert rows(pages, "page_num", "name") == [(1, "a.png"), (2, "b.PNG")]
    kept = P.scan_page_folder(spark, folder, unreadable="keep")
    assert rows(kept.where("image IS NULL"), "page_num", "name") == [(3, "c.jpg")]
    assert pages.where("name = 'a.png'").select("image.width", "image.nChannels").first() == (8, 3)


def test_single_image(spark, folder):
    assert P.scan_single_image(spark, folder + "/a.png").first().error is None
    bad = P.scan_single_image(spark, folder + "/c.jpg").first()
    assert bad.image is None and bad.error == "cannot decode image: c.jpg"


def test_archives(spark, folder):
    archives = P.read_archives(spark, folder)
    assert rows(P.expand_archives(archives), "page_num", "name") == [(1, "1.png"), (2, "2_2.png"), (3, "x/2.png"), (4, "y/2.png")]
    with open(folder + "/bad.zip", "wb") as f:
        f.write(b"PK no archive")
    mixed = P.read_archives(spark, folder).unionByName(spark.createDataFrame([("/none.zip", 0)], "path string, length long"))
    assert P.expand_archives(mixed).count() == 4
    kept = P.expand_archives(mixed, unreadable="keep")
    bad = [r.source_id for r in kept.where("error is not null").collect()]
    assert sorted(b.rsplit("/", 1)[1] for b in bad) == ["bad.zip", "none.zip"] and kept.count() == 6
    unique = P.expand_archives(archives, unique_names=True)
    assert rows(unique, "page_num", "name") == [(1, "1.png"), (2, "2_2.png"), (3, "2.png"), (4, "2_3.png")]
    key = unique.select("cache_key").first()[0]
    assert key.startswith("book_") and len(key) == len("book_") + 12
    assert {bytes(r.data) for r in unique.collect()} == {b"1.png", b"2_2.png", b"x/2.png", b"y/2.png"}


def test_large_archive_is_read_by_many_tasks(spark, tmp_path):
    """Ranges of entries go to several tasks; names and numbers are those of the sequential walk."""
    rng = np.random.default_rng(5)
    names = [f"{d}/{n}.{e}" for d in "abc" for n in ("1", "1_2", "2", "2_2_2") for e in ("png", "JPG")] + ["a/1_3.png", "a/no.txt", "a/.png"]
    with zipfile.ZipFile(tmp_path / "big é.zip", "w") as z:
        for name in names:
            z.writestr(name, name.encode() + rng.bytes(20_000))
    archives = P.read_archives(spark, str(tmp_path))
    found = P.expand_archives(archives, unique_names=True, task_bytes=60_000)
    assert found.rdd.getNumPartitions() >= 6
    used, want = set(), []
    for k, entry in enumerate(sorted(n for n in names if n.lower().endswith(("png", "jpg")) and not n.endswith("/.png"))):
        stem, ext = entry.split("/")[1].rsplit(".", 1)
        name = next(c for c in (f"{stem}{s}.{ext}" for s in ["", *(f"_{i}" for i in range(2, 99))]) if c not in used)
        used.add(name)
        want.append((k + 1, name, entry))
    got = sorted((r.page_num, r.name, bytes(r.data)[: -20_000].decode()) for r in found.collect())
    assert got == want


def test_intake_reads_changes_only(spark, folder, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    assert intake.take_in(spark, folder, store) == 4
    first = rows(intake.stored_pages(spark, store), "page_num", "name")
    assert first == sorted([(1, "1.png"), (2, "2_2.png"), (3, "2.png"), (4, "2_3.png"), (1, "a.png"), (2, "b.PNG"), (3, "c.jpg")], key=repr)
    monkeypatch.setattr(intake, "expand_archives", None)  # content cannot be read any more
    assert intake.take_in(spark, folder, store) == 0 and intake.changed_files(spark, folder, store).count() == 0
    monkeypatch.undo()
    with open(folder + "/aa.png", "wb") as f:
        f.write(png(flat(3)))
    with zipfile.ZipFile(folder + "/book.cbz", "w") as z:
        z.writestr("only.png", b"new")
    assert intake.take_in(spark, folder, store) == 2
    assert rows(intake.stored_pages(spark, store), "page_num", "name") == sorted([(1, "only.png"), (1, "a.png"), (2, "aa.png"), (3, "b.PNG"), (4, "c.jpg")], key=repr)


def test_mixed_folder(spark, folder):
    pages, rest = P.read_pages(spark, folder)
    got = sorted((r.source_id.rsplit("/", 1)[1], r.page_num, r.name) for r in pages.collect())
    assert got == [("book.cbz", 1, "1.png"), ("book.cbz", 2, "2_2.png"), ("book.cbz", 3, "x/2.png"), ("book.cbz", 4, "y/2.png"),
                   ("pages", 1, "a.png"), ("pages", 2, "b.PNG"), ("pages", 3, "c.jpg")]
    one, none = P.read_pages(spark, folder + "/a.png")
    assert [(r.page_num, r.name) for r in one.collect()] == [(1, "a.png")] and none.count() == 0
    assert [r.path.rsplit("/", 1)[1] for r in rest.collect()] == ["notes.txt"]


def test_requests(spark, tmp_path):
    good = base64.b64encode(b"img").decode()
    lines = [json.dumps({"image_b64": good, "output_dir": "o"}), "", "{oops", json.dumps({"image_b64": good, "output_dir": "o", "page_num": 4, "rtl": True}),
             json.dumps({"output_dir": "o"})]
    path = tmp_path / "req"
    path.mkdir()
    (path / "r.jsonl").write_text("\n".join(lines))
    got = read_requests(spark, str(path))
    assert rows(got, "page_num", "reading_order", "rtl", "error") == [
        (1, True, False, "image_b64 missing"), (1, True, False, "invalid JSON"), (1, True, False, None), (4, True, True, None)]
    query = write_batches(stream_requests(spark, str(path)), lambda b: b.select("page_num", "error"), str(tmp_path / "out"),
                          str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_stream_suppression(spark, tmp_path):
    schema = "page_id long, x1 int, y1 int, x2 int, y2 int, score double"
    spark.createDataFrame([(1, 0, 0, 10, 10, .9), (1, 0, 0, 10, 9, .8), (2, 0, 0, 5, 5, .5)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    write_batches(stream, nms, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_document_round_trip(spark, tmp_path):
    panels = spark.createDataFrame([("книга", 1, "panels/1.png", 0), ("книга", 2, "panels/2.png", 1)],
                                   "project string, panel_id long, image_path string, pos int")
    bubbles = spark.createDataFrame([(1, "1_b1", 1, 1, 2, 3, 4, "Привет", "Привет!", "speech")],
                                    "panel_id long, bubble_id string, reading_order int, x1 int, y1 int, x2 int, y2 int, "
                                    "raw_text string, corrected_text string, type string")
    docs = D.build_documents(panels, bubbles)
    docs_io.write_document_lines(docs, str(tmp_path / "docs"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "docs").glob("part-*"))
    assert "Привет!" in text and json.loads(text)["panels"][1] == {"panel_id": "2", "image_path": "panels/2.png", "bubbles": []}
    back = docs_io.read_document_lines(spark, str(tmp_path / "docs"))
    assert back.collect() == docs.collect()
    (tmp_path / "one.json").write_text('{\n "project": "p",\n "panels": [{"panel_id": "a", "image_path": "i"}]\n}')
    one = docs_io.read_document_lines(spark, str(tmp_path / "one.json"), multi_line=True).first()
    assert one.panels[0].bubbles == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "b")], "source_id string, global_order int, file_name string")
    write_panel_manifest(df, str(tmp_path / "m"))
    assert (tmp_path / "m" / "source_id=s1").is_dir()
    assert rows(spark.read.parquet(str(tmp_path / "m")), "source_id", "global_order", "file_name") == rows(df)[:0] + [("s1", 1, "a"), ("s2", 2, "b")]
    write_report_csv(df, str(tmp_path / "c"), ["file_name", "source_id"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text.startswith("file_name,source_id\n") and "global_order" not in text


def test_manifest_of_many_sources(spark, tmp_path):
    """Above the limit sources share folders, and every row can be read as before."""
    df = spark.range(3000).selectExpr("id div 2 AS source_id", "CAST(id AS INT) AS global_order", "concat('f', id) AS file_name")
    write_panel_manifest(df, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("source*"))) <= 64
    assert rows(spark.read.schema(df.schema).parquet(str(tmp_path / "m")), *df.columns) == rows(df, *df.columns)


def image_frame(spark, arrays):
    data = [(i, tuple(I.image_dict("m", a).values())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(data, f"page_id int, image {I.IMAGE_TYPE}")


def test_image_jobs(spark):
    half = np.concatenate([flat(10, 4, 3), flat(10, 4, 3)], axis=0)
    alpha = np.dstack([flat(100, 4, 3), np.full((4, 4), 51, np.uint8)])
    df = image_frame(spark, [flat(20), flat(240), alpha, flat(7, 4, 1), half])
    inverted = {r[0]: r[1] for r in df.select("page_id", I.mean_luminance(I.invert_dark("image"))).collect()}
    assert inverted[0] > 200 and inverted[1] > 200
    white = {r.page_id: r.im for r in df.select("page_id", I.composite_on_white("image").alias("im")).collect()}
    assert white[2].nChannels == 3 and set(white[2].data) == {int(np.float32(100) * np.float32(0.2) + np.float32(255) * np.float32(0.8))}
    assert white[3].nChannels == 3 and set(white[3].data) == {7}
    plain = {r.page_id: r.im for r in df.select("page_id", I.composite_on_white("image", composite=False).alias("im")).collect()}
    assert set(plain[2].data) == {100}
    seam = flat(0, 8, 1)
    seam[:, 4:] = 100
    scores = image_frame(spark, [seam, flat(1, 4, 1)]).select("page_id", I.image_seam_score("image", 4).alias("s")).orderBy("page_id").collect()
    assert [r.s for r in scores] == [50.0, None]


def test_crops(spark):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8, 1)
    pages = image_frame(spark, [image])
    windows = spark.createDataFrame([(0, k, k, 0, k + 2, 1, k == 2) for k in range(5)],
                                    "page_id int, det_id int, wx1 int, wy1 int, wx2 int, wy2 int, empty boolean")
    for per_image in (100, 2):
        got = I.crop_regions(pages, windows, per_image=per_image).orderBy("det_id").collect()
        assert [bytes(r.crop.data) for r in got] == [b"\0\1", b"\1\2", b"\0", b"\3\4", b"\4\5"]


def test_models(spark, folder):
    pages = P.scan_page_folder(spark, folder)

    def loader():
        return lambda batch: [[(0, 0, i["width"], i["height"], .5, 0)] * 2 for i in batch["image"]]

    found = detect(pages, loader, keys=["source_id", "page_num"])
    assert rows(found.drop("source_id"), "page_num", "det_id", "x2") == [(1, 0, 8.0), (1, 1, 8.0), (2, 0, 8.0), (2, 1, 8.0)]
    crops = pages.select(F.col("page_num").alias("page_id"), F.lit(0).alias("det_id"), F.col("image").alias("crop"))

    def local():
        return lambda c: [" " if i["data"][0] == 20 else "near" for i in c]

    out = recognize(crops, local, lambda: lambda c: ["far"] * len(c), engine="t1")
    assert rows(out, "page_id", "text", "engine") == [(1, "near", "paddle"), (2, "far", "siliconflow")]

    def broken():
        def fail(_):
            raise RuntimeError("no engine")
        return fail

    out = recognize(crops, broken, lambda: lambda c: ["far"] * len(c), engine="t2")
    assert {r.text for r in out.collect()} == {"far"}
