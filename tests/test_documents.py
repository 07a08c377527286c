"""Documents as rows, as one file per project, and as a versioned table."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from foliospark.operators import documents as D
from foliospark.plans import cataloguing
from foliospark.sources import document_table as table
from foliospark.sources import documents as docs_io

COLS = ("project", "pos", "slice", "panel_id", "image_path", "bubbles")


def frames(spark, panels=7, bubbles=5, project="книга"):
    left = spark.createDataFrame([(project, str(k), f"i{k}.png", k) for k in range(panels)], "project string, panel_id string, image_path string, pos int")
    right = spark.createDataFrame(
        [(str(k), f"{k}_b{n}", n if n % 3 else None, n, 0, n + 1, 9, f"Текст {n}\n\"x\"", None, None) for k in range(panels) if k % 4 for n in range(bubbles)],
        "panel_id string, bubble_id string, reading_order int, x1 int, y1 int, x2 int, y2 int, raw_text string, corrected_text string, type string")
    return left, right


def exploded(doc_rows):
    """Bubbles in document order, whatever the slices."""
    flat = doc_rows.select("project", "pos", "slice", "panel_id", F.posexplode_outer("bubbles").alias("n", "b"))
    return [(r.project, r.panel_id, r.b) for r in flat.orderBy("project", "pos", "slice", "n").collect()]


def test_rows_are_keyed_at_every_size(spark):
    left, right = frames(spark)
    whole = D.document_rows(left, right)
    for limit in (None, 1):
        cut = D.document_rows(left, right, slice_size=2, limit=limit)
        assert cut.groupBy("project", "pos", "slice").count().where("count > 1").count() == 0
        assert cut.agg(F.max(F.size("bubbles"))).first()[0] == 2 and exploded(cut) == exploded(whole)
    parts = D.nest_rows(cut, part_size=4)
    assert parts.count() == -(-cut.count() // 4) and parts.select(F.sum(F.size("panels"))).first()[0] == cut.count()


def update(spark, panel, texts, project="книга"):
    values = [(f"n{k}", [0, 0, 1, 1], t, t, "speech", k) for k, t in enumerate(texts)]
    return spark.createDataFrame([(project, panel, values)], f"project string, panel_id string, bubbles array<{D.BUBBLE_TYPE}>")


def test_upsert_of_split_panels(spark):
    left, right = frames(spark)
    for new in ("abcde", "ab", "", "abcdefg"):
        changed = update(spark, "3", new).unionByName(update(spark, "99", "x"))
        want, unknown = D.upsert_panel(D.document_rows(left, right), changed)
        got, _ = D.upsert_panel(D.document_rows(left, right, slice_size=2), changed, slice_size=2)
        assert exploded(got) == exploded(want) and len([r for r in exploded(got) if r[1] == "3"]) == max(len(new), 1)
        assert got.agg(F.max(F.size("bubbles"))).first()[0] == 2 and rows(unknown, "panel_id") == [("99",)]
        nested = D.explode_panels(D.build_documents(left, right, part_size=2)).drop("slice")
        merged, _ = D.upsert_panel(nested, changed)
        assert merged.where("panel_id = '3'").count() == 1
        assert merged.where("panel_id = '3'").first().bubbles == want.where("panel_id = '3'").first().bubbles
        assert rows(merged.where("panel_id <> '3'"), "panel_id", "bubbles") == rows(nested.where("panel_id <> '3'"), "panel_id", "bubbles")


def test_one_file_per_project(spark, tmp_path):
    left, right = frames(spark)
    more = spark.createDataFrame([(p, f"q{i}", None, 0) for i, p in enumerate(["", None, "a/b ü%", "x" * 300])], "project string, panel_id string, image_path string, pos int")
    docs = D.document_rows(left.unionByName(more), right, slice_size=2)
    folder = str(tmp_path / "docs")
    docs_io.write_documents(docs.repartition(5), folder)
    files = sorted(os.listdir(folder))
    assert len(files) == 5 and all(f.startswith("project") for f in files)
    text = open(f"{folder}/{docs_io.file_name('книга')}", encoding="utf-8").read()
    panels = json.loads(text)["panels"]
    assert [p["panel_id"] for p in panels] == [str(k) for k in range(7)] and [len(p["bubbles"]) for p in panels] == [0, 5, 5, 5, 0, 5, 5]
    back = docs_io.read_documents(spark, folder, slice_size=2)
    assert rows(back, *COLS) == rows(docs, *COLS)
    assert exploded(docs_io.read_documents(spark, folder)) == exploded(docs)
    # Only what is written again is replaced, unless all is to be.
    one = docs.where("project = 'a/b ü%'").withColumn("image_path", F.lit("new"))
    docs_io.write_documents(one, folder, overwrite=False)
    assert sorted(os.listdir(folder)) == files and docs_io.read_documents(spark, folder).where("image_path = 'new'").count() == 1
    docs_io.write_documents(one, folder)
    assert os.listdir(folder) == [docs_io.file_name("a/b ü%")]
    docs_io.write_documents(docs.limit(0), folder)
    assert os.listdir(folder) == [] and docs_io.read_documents(spark, folder).count() == 0


def test_large_project_is_one_file(spark, tmp_path):
    left = spark.range(25_000).select(F.lit("big").alias("project"), F.col("id").cast("string").alias("panel_id"), F.lit("i").alias("image_path"), F.col("id").alias("pos"))
    right = left.where("pos % 5 = 0").select("panel_id", F.lit("b").alias("bubble_id"), F.lit(1).alias("reading_order"), *[F.lit(1).alias(c) for c in ("x1", "y1", "x2", "y2")],
                                             F.lit("t").alias("raw_text"), F.lit("").alias("corrected_text"), F.lit("speech").alias("type"))
    docs = D.document_rows(left, right, slice_size=1000)
    docs_io.write_documents(docs, str(tmp_path / "d"))
    assert os.listdir(tmp_path / "d") == ["project-big.json"]
    both = docs.select(*COLS).exceptAll(docs_io.read_documents(spark, str(tmp_path / "d")).select(*COLS))
    assert both.count() == 0 and docs_io.read_documents(spark, str(tmp_path / "d")).count() == 25_000


def test_failed_write_leaves_nothing(spark, tmp_path):
    left, right = frames(spark)
    folder = str(tmp_path / "docs")
    docs_io.write_documents(D.document_rows(left, right), folder)
    before = open(f"{folder}/{docs_io.file_name('книга')}", "rb").read()
    broken = D.document_rows(left, right).withColumn("image_path", F.when(F.col("pos") == 6, F.raise_error(F.lit("lost"))).otherwise(F.lit("changed")))
    with pytest.raises(Exception, match="lost"):
        docs_io.write_documents(broken, folder)
    assert os.listdir(folder) == [docs_io.file_name("книга")] and open(f"{folder}/{docs_io.file_name('книга')}", "rb").read() == before


def test_foreign_file(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "project": "p",\n "panels": [{"panel_id": "a", "image_path": "i"}, {"panel_id": "b", "bubbles": [{"bubble_id": "x"}]}]\n}')
    got = docs_io.read_documents(spark, str(tmp_path / "one.json")).orderBy("pos").collect()
    assert [(r.project, r.pos, r.panel_id, len(r.bubbles)) for r in got] == [("p", 0, "a", 0), ("p", 1, "b", 1)]


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, found in os.walk(path) for f in found if f.endswith(".parquet")}


def test_versioned_table(spark, tmp_path):
    left, right = frames(spark, panels=60)
    docs, path = D.document_rows(left, right, slice_size=2), str(tmp_path / "t")
    assert table.create_document_table(docs, path, buckets=8) == 1
    assert rows(table.read_document_table(spark, path), *COLS) == rows(docs, *COLS)
    before = files_of(path)
    changed = update(spark, "3", "abcde").unionByName(update(spark, "7", "z")).unionByName(update(spark, "99", "y"))
    version, unknown = table.merge_document_table(changed, path, slice_size=2)
    want, _ = D.upsert_panel(D.document_rows(left, right), changed)
    assert version == 2 and rows(unknown, "panel_id") == [("99",)] and exploded(table.read_document_table(spark, path)) == exploded(want)
    assert rows(table.read_document_table(spark, path, 1), *COLS) == rows(docs, *COLS)
    after = files_of(path)
    assert {k: after[k] for k in before} == before
    new = {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)}
    assert 1 <= len(new) <= 3  # of 8
    with pytest.raises(table.ConcurrentUpdate):
        table._commit(spark, path, 2, {})
    with pytest.raises(ValueError):
        table.create_document_table(docs, path)
    assert table.merge_document_table(changed.limit(0), path)[0] == 2
    assert table.expire_versions(spark, path) == len(new) and exploded(table.read_document_table(spark, path)) == exploded(want)
    assert table.versions(spark, path) == [2]


def test_check_sql_of_projects_above_a_part(spark, tmp_path):
    """More panels than one part holds, and bubbles with equal ids and other texts."""
    duckdb = pytest.importorskip("duckdb")
    spark.range(D.PART_SIZE + 12).selectExpr("id AS doc_id", "concat('s', id div 10010) AS source").write.parquet(str(tmp_path / "documents.parquet"))
    said = spark.range(40).selectExpr("id div 8 AS conv_id", "CAST(id % 8 div 2 AS INT) AS turn", "concat('t', (id * 7) % 10) AS text")
    said.write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("build_documents", "document_json"):
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.sql(cataloguing.ORACLE[name])
        got = cataloguing.QUERIES[name](spark, str(tmp_path))
        assert rows(got, *want.columns) == sorted(want.fetchall(), key=repr)
        assert got.agg(F.max("part_no")).first()[0] == 1
