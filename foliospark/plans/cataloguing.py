"""Listings, file presence, settings, documents and names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliospark.functions import names as N
from foliospark.functions.maps import map_merge
from foliospark.operators import catalog as C
from foliospark.operators import documents as D
from foliospark.operators import text as X
from foliospark.plans.check_sql import views
from foliospark.plans.fixtures import Tables
from foliospark.session import checkpoint_folder
from foliospark.sources.document_table import create_document_table, merge_document_table, read_document_table
from foliospark.sources.documents import read_documents, write_documents
from foliospark.sources.requests import parse_requests

_EXTS = "array('png', 'JPG', 'jpeg', 'cbz', 'txt', 'webp')"
_HOST = "regexp_extract(url, '//([^/]+)/', 1)"


def _listing(t: Tables):
    return t.read("pages").selectExpr(
        f"{_HOST} AS folder", "page_id", f"concat('page_', page_id, '.', element_at({_EXTS}, CAST(page_id % 6 + 1 AS INT))) AS name")


def read_listing(spark, d):
    files = _listing(Tables(spark, d)).selectExpr("concat('/in/', folder, '/', name) AS path", "page_id")
    return C.read_listing(files, is_dir=F.col("page_id") % 17 == 0)


def list_panels(spark, d):
    return C.list_panels(_listing(Tables(spark, d)))


def list_projects(spark, d):
    folders = Tables(spark, d).read("customer").selectExpr(
        "concat(CASE WHEN c_nationkey % 5 = 0 THEN '.' ELSE '' END, c_mktsegment, '_', c_nationkey) AS name")
    return C.list_projects(folders, query=" Mach")


def _stock(t: Tables):
    """Two listings with names of their own and names in common: (source, target)."""
    def named(table: str, key: str, path: str):
        return t.read(table).selectExpr(f"concat('book_', {key} % 7) AS project", f"concat('page_', {key}, '.png') AS name", f"{path} AS path")

    return named("pages", "page_id", "url"), named("labels", "doc_id", "'old'")


def sync_panels_append(spark, d):
    return C.sync_panels(*_stock(Tables(spark, d)), mode="append")


def sync_panels_replace(spark, d):
    return C.sync_panels(*_stock(Tables(spark, d)), mode="replace")


def sync_diff(spark, d):
    return C.sync_diff(*_stock(Tables(spark, d)))


def _panel_sources(t: Tables):
    panels = t.read("documents").selectExpr(
        "concat('book_', doc_id % 7) AS project", "concat('page_', doc_id) AS panel_id", "concat('panels/page_', doc_id, '.png') AS image_path")
    source = _listing(t).selectExpr("concat('book_', page_id % 7) AS project", "name", "concat('src/', page_id) AS path")
    copies = t.read("labels").selectExpr(
        "concat('book_', doc_id % 7) AS project", "concat('page_', doc_id, '.png') AS name", "concat('copy/', doc_id) AS path")
    return panels, source, copies


def prefer_source_path(spark, d):
    return C.prefer_source_path(*_panel_sources(Tables(spark, d)))


def prefer_source_path_strict(spark, d):
    return C.prefer_source_path(*_panel_sources(Tables(spark, d)), strict=True)


def _artifacts(t: Tables):
    required = t.read("part").selectExpr("p_brand AS brand", "p_size AS size", "p_partkey AS item")
    present = t.read("lineitem").where("l_quantity > 47 AND l_returnflag = 'R'").selectExpr("l_partkey AS item").distinct()
    return required, present


def missing_artifacts(spark, d):
    return C.missing_artifacts(*_artifacts(Tables(spark, d)))


def artifact_status(spark, d):
    return C.artifact_status(*_artifacts(Tables(spark, d)), owner=["brand", "size"])


def installed_only(spark, d):
    t = Tables(spark, d)
    status = C.artifact_status(*_artifacts(t), owner=["brand", "size"])
    cases = t.read("part").selectExpr("p_brand AS brand", "p_size AS size", "p_partkey AS case_id")
    return C.installed_only(cases, status, key=["brand", "size"], only=["Brand#1", "Brand#2", "Brand#3", "Brand#11"])


def case_matrix(spark, d):
    return C.case_matrix(Tables(spark, d).read("supplier").selectExpr("s_suppkey AS panel"))


def detector_matrix(spark, d):
    return C.detector_matrix(Tables(spark, d).page().select("page_id"))


def lookup_detector(spark, d):
    raw = Tables(spark, d).read("part").selectExpr(
        "p_partkey", "element_at(array('manga', ' Comic ', 'MANGA', 'unknown', CAST(NULL AS STRING)), CAST(p_partkey % 5 + 1 AS INT)) AS detector")
    return C.lookup_detector(raw)


def lookup_variant(spark, d):
    t = Tables(spark, d)
    dim = t.read("nation").selectExpr("n_regionkey AS backend", "n_nationkey AS variant", "n_name AS label")
    asked = t.read("customer").selectExpr("c_custkey", "CAST(c_custkey % 5 AS INT) AS backend", "c_nationkey AS variant")
    return C.lookup_settings(asked, dim, key=["backend", "variant"], default={"label": "unknown"})


_BACKENDS = "array('realesrgan', 'NCNN_vulkan', ' cugan ', 'span', 'other')"
_MODELS = "array('animevideov3', 'anime_6B', 'cugan_se', 'span_x2_ch48', 'span_x4_ch48', 'custom', 'x')"


def resolve_upscale(spark, d):
    asked = Tables(spark, d).read("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"element_at({_BACKENDS}, CAST(l_partkey % 5 + 1 AS INT)) AS backend",
        f"element_at({_MODELS}, CAST(l_suppkey % 7 + 1 AS INT)) AS model", "CAST(l_quantity AS INT) % 6 AS scale",
        "CASE WHEN l_linenumber <> 3 THEN l_linenumber - 2 END AS gpu")
    b, m = F.col("backend"), F.col("model")
    return asked.select("l_orderkey", "l_linenumber", N.canonical_engine(b, "upscale").alias("engine"), "model", F.col("scale").alias("asked"),
                        C.resolve_scale(b, m, F.col("scale")).alias("scale"), C.resolve_gpu(b, F.col("gpu")).alias("gpu"),
                        F.array_join(C.allowed_scales(b, m), ",").alias("offered"))


def attach_results(spark, d):
    from foliospark.operators.order import number_pages

    t = Tables(spark, d)
    pages = number_pages(t.page()).select("source_id", "page_num", "name", "page_id")
    results = (t.det().groupBy("page_id").agg(F.count(F.lit(1)).alias("boxes")).join(pages, "page_id")
               .select("source_id", "page_num", "name", "boxes"))
    return C.attach_results(pages, results)


_ENUMS = {"Customer#000000002": ("1-URGENT", "2-HIGH"), "Customer#000000005": ("1-URGENT",), "Customer#000000007": ("5-LOW", "")}


def layer_settings(spark, d):
    t = Tables(spark, d)
    base = t.read("customer").where("c_acctbal > 0").selectExpr("c_custkey % 25 AS section", "c_name AS key", "c_mktsegment AS value")
    patch = t.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p")).selectExpr(
        "o_custkey % 25 AS section", "format_string('Customer#%09d', o_custkey) AS key",
        "CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p END AS value")
    return C.layer_settings(base, patch, enums=_ENUMS)


# --- documents -----------------------------------------------------------------------------------

def _panels(t: Tables):
    """Panels of every document id; most have no bubbles."""
    return t.read("documents").selectExpr(
        "source AS project", "doc_id AS panel_id", "concat('panels/', doc_id, '.png') AS image_path", "doc_id AS pos")


def _texts(t: Tables):
    return t.bubble().selectExpr(
        "panel_id", "bubble_id", "pos + 1 AS reading_order", "raw_text", "CASE WHEN pos % 2 = 0 THEN raw_text END AS corrected_text",
        "CASE WHEN pos % 3 = 0 THEN 'sfx' END AS type", "x1", "y1", "x2", "y2")


def build_documents(spark, d):
    t = Tables(spark, d)
    return D.explode_bubbles(D.build_documents(_panels(t), _texts(t)))


def document_json(spark, d):
    t = Tables(spark, d)
    return D.document_json(D.build_documents(_panels(t), _texts(t)))


def bubbles_json(spark, d):
    t = Tables(spark, d)
    flipped = _texts(t).select("panel_id", "bubble_id", D.bubbles_to_json(F.array(
        F.struct("bubble_id", F.array("x2", "y2", "x1", "y1").alias("bbox"), F.lit(None).cast("string").alias("raw_text"),
                 F.col("raw_text").alias("corrected_text"), "type", "reading_order"))).alias("json"))
    back = flipped.select("panel_id", F.explode(D.parse_bubbles("json")).alias("b"))
    return back.select("panel_id", "b.bubble_id", "b.raw_text", "b.corrected_text", "b.type", "b.reading_order",
                       *[F.get("b.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def upsert_panel(spark, d):
    t = Tables(spark, d)
    docs = D.explode_panels(D.build_documents(_panels(t), _texts(t))).select("project", "panel_id", "image_path", "bubbles")
    seen = t.read("labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("panel_id"))
    updates = docs.join(seen, "panel_id", "left_semi").withColumn("bubbles", F.transform(
        F.slice("bubbles", 1, 2), lambda b: b.withField("corrected_text", F.lit("seen"))))
    merged, _ = D.upsert_panel(docs, updates)
    return merged.select("project", "panel_id", F.size("bubbles").alias("bubbles"),
                         F.array_join(F.transform("bubbles", lambda b: b.getField("corrected_text")), "|").alias("texts"))


def unknown_updates(spark, d):
    t = Tables(spark, d)
    docs = D.explode_panels(D.build_documents(_panels(t), _texts(t))).select("project", "panel_id", "bubbles")
    updates = docs.withColumn("panel_id", F.expr("CASE WHEN CAST(panel_id AS BIGINT) % 4 = 0 THEN concat(panel_id, 'x') ELSE panel_id END"))
    return D.upsert_panel(docs, updates)[1].select("project", "panel_id")


def document_files(spark, d):
    """Documents in slices of two bubbles, written as one file per project and read again."""
    t, path = Tables(spark, d), f"{checkpoint_folder(spark)}/documents-{uuid.uuid4().hex}"
    write_documents(D.document_rows(_panels(t), _texts(t), slice_size=2), path)
    said = F.array_join(F.transform("bubbles", lambda b: b.getField("corrected_text")), "|")
    return read_documents(spark, path, slice_size=2).select(
        "project", "pos", "slice", "panel_id", "image_path", F.size("bubbles").alias("bubbles"), said.alias("texts"))


def document_table_upsert(spark, d):
    """The update of ``upsert_panel`` merged into a bucketed table whose panels are cut into slices of two bubbles."""
    t, path = Tables(spark, d), f"{checkpoint_folder(spark)}/documents-{uuid.uuid4().hex}"
    create_document_table(D.document_rows(_panels(t), _texts(t), slice_size=2), path, buckets=16)
    seen = t.read("labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("panel_id"))
    updates = D.document_rows(_panels(t), _texts(t)).join(seen, "panel_id", "left_semi").withColumn("bubbles", F.transform(
        F.slice("bubbles", 1, 2), lambda b: b.withField("corrected_text", F.lit("seen"))))
    merge_document_table(updates, path, slice_size=2)
    said = F.transform("bubbles", lambda b: b.getField("corrected_text"))
    slices = F.sort_array(F.collect_list(F.struct("slice", said.alias("said"))))
    return read_document_table(spark, path).groupBy("project", "panel_id").agg(
        F.sum(F.size("bubbles")).cast("int").alias("bubbles"), F.array_join(F.flatten(F.transform(slices, lambda s: s["said"])), "|").alias("texts"))


# --- names and texts -------------------------------------------------------------------------------

def path_names(spark, d):
    path = F.expr("CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 9 = 1 THEN concat('in\\\\', page_id, '.tar.GZ') "
                  "WHEN page_id % 9 = 2 THEN '/in/.hidden' WHEN page_id % 9 = 3 THEN concat('dir/', page_id) ELSE url END")
    return Tables(spark, d).read("pages").withColumn("path", path).select(
        "page_id", N.file_stem("path").alias("stem"), N.file_ext("path").alias("ext"), N.panel_rel_path("path").alias("rel_path"))


def sanitize_names(spark, d):
    name = F.concat(F.lit("  "), F.substring_index("text", ".", 1), F.lit(" -"))
    return Tables(spark, d).read("documents").select("doc_id", N.sanitize_name(name).alias("project"))


def canonical_engine(spark, d):
    raw = F.expr("element_at(array('EasyOCR', ' paddle', 'AUTO ', 'tesseract', CAST(NULL AS STRING), 'siliconflow', 'cugan', 'esrgan', 'Span', 'manga'), "
                 "CAST(event_id % 10 + 1 AS INT))")
    return Tables(spark, d).read("events").select(
        "event_id", N.canonical_engine(raw).alias("ocr"), N.canonical_engine(raw, "upscale").alias("upscale"),
        N.canonical_engine(raw, "detector").alias("detector"))


def repair_mojibake(spark, d):
    t = Tables(spark, d)
    ended = F.concat("text", F.lit("."))
    return t.read("documents").select("doc_id", X.repair_mojibake(F.decode(F.encode(ended, "UTF-8"), "ISO-8859-1")).alias("text"))


def text_or_fallback(spark, d):
    rows = Tables(spark, d).read("conversations").selectExpr(
        "conv_id", "turn", "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '  \\n ' WHEN 2 THEN '' END AS near", "concat('cloud ', turn) AS far")
    text, engine = X.text_or_fallback("near", "far")
    return rows.select("conv_id", "turn", text.alias("text"), engine.alias("engine"))


def _lines(t: Tables):
    return (t.read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
            .selectExpr("doc_id", "pos", "(pos * 37) % 101 AS y", "CASE WHEN pos % 7 = 6 THEN '' ELSE concat(' ', text, ' ') END AS text"))


def merge_text_lines(spark, d):
    return X.merge_text_lines(_lines(Tables(spark, d)))


def merge_text_simple(spark, d):
    return X.merge_text_lines(_lines(Tables(spark, d)), simple=True)


def map_merge_rows(spark, d):
    rows = Tables(spark, d).read("customer").select(
        "c_custkey", map_merge(F.create_map(F.lit("a"), F.col("c_nationkey"), F.lit("b"), F.lit(1)),
                               F.create_map(F.lit("b"), F.col("c_nationkey") + 2, F.lit("c"), F.lit(3))).alias("m"))
    return rows.select("c_custkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


def parse_request_lines(spark, d):
    line = F.expr("""CASE WHEN event_id % 11 = 0 THEN '   ' WHEN event_id % 11 = 1 THEN '{"page_num": '
      WHEN event_id % 11 = 2 THEN concat('{"image_b64": "', base64(encode(event_type, 'UTF-8')), '"}')
      WHEN event_id % 11 = 3 THEN '{"image_b64": "@@", "output_dir": "o"}'
      ELSE concat('{"image_b64": "', base64(encode(event_type, 'UTF-8')), '", "output_dir": "o', user_id, '"',
                  CASE WHEN event_id % 2 = 0 THEN concat(', "page_num": ', event_id % 50, ', "rtl": true') ELSE ', "reading_order": false' END, '}') END""")
    return parse_requests(Tables(spark, d).read("events").select(line.alias("value"))).withColumn("data", F.decode("data", "UTF-8"))


_LISTING_SQL = """
listing AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS folder, page_id,
                   'page_' || page_id || '.' || ['png', 'JPG', 'jpeg', 'cbz', 'txt', 'webp'][page_id % 6 + 1] AS name FROM pages)"""
_STOCK_SQL = """
src AS (SELECT 'book_' || (page_id % 7) AS project, 'page_' || page_id || '.png' AS name, url AS path FROM pages),
tgt AS (SELECT 'book_' || (doc_id % 7) AS project, 'page_' || doc_id || '.png' AS name, 'old' AS path FROM labels)"""
_ARTIFACT_SQL = """
required AS (SELECT p_brand AS brand, p_size AS size, p_partkey AS item FROM part),
present AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_quantity > 47 AND l_returnflag = 'R'),
status AS (SELECT brand, size, count(*) AS n_required, count(*) FILTER (WHERE item NOT IN (SELECT item FROM present)) AS n_missing
           FROM required GROUP BY brand, size)"""
_DOC_SQL = """
panels AS (SELECT source AS project, doc_id AS panel_id, 'panels/' || doc_id || '.png' AS image_path FROM documents),
texts AS (SELECT panel_id, bubble_id, pos + 1 AS reading_order, raw_text, CASE WHEN pos % 2 = 0 THEN raw_text ELSE '' END AS corrected_text,
                 CASE WHEN pos % 3 = 0 THEN 'sfx' ELSE 'speech' END AS type, x1, y1, x2, y2 FROM bubble)"""
# Bubbles of a panel in slices, and panels (by id) in parts, of PART_SIZE each.
_PARTS_SQL = f"""
cut AS (SELECT *, (nth - 1) // {D.PART_SIZE} AS slice FROM (
  SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY reading_order, bubble_id, raw_text) AS nth FROM texts)),
parts AS (
  SELECT *, CAST((place - 1) // {D.PART_SIZE} AS BIGINT) AS part_no FROM (
    SELECT p.*, coalesce(c.slice, 0) AS slice, row_number() OVER (PARTITION BY project ORDER BY p.panel_id, coalesce(c.slice, 0)) AS place
    FROM panels p LEFT JOIN (SELECT DISTINCT panel_id, slice FROM cut) c ON c.panel_id = p.panel_id))"""


def _prefer(copy: str) -> str:
    return f"""SELECT 'book_' || (doc_id % 7) AS project, 'page_' || doc_id AS panel_id, 'panels/page_' || doc_id || '.png' AS image_path,
       CASE WHEN doc_id IN (SELECT page_id FROM pages WHERE page_id % 6 NOT IN (3, 4)) THEN 'src/' || doc_id {copy} ELSE '' END AS abs_path
FROM documents"""


QUERIES = {f.__name__: f for f in (
    read_listing, list_panels, list_projects, sync_panels_append, sync_panels_replace, sync_diff, prefer_source_path,
    prefer_source_path_strict, missing_artifacts, artifact_status, installed_only, case_matrix, detector_matrix,
    lookup_detector, lookup_variant, resolve_upscale, attach_results, layer_settings, build_documents, document_json,
    bubbles_json, upsert_panel, unknown_updates, document_files, document_table_upsert, path_names, sanitize_names, canonical_engine, repair_mojibake,
    text_or_fallback, merge_text_lines, merge_text_simple, map_merge_rows, parse_request_lines)}

ORACLE = {
    "read_listing": f"""WITH {_LISTING_SQL}
SELECT '/in/' || folder || '/' || name AS path, page_id,
       CASE WHEN page_id % 17 = 0 THEN 'folder' WHEN page_id % 6 < 3 THEN 'file' WHEN page_id % 6 = 3 THEN 'archive'
            ELSE 'unsupported' END AS source_kind FROM listing""",
    "list_panels": f"""WITH {_LISTING_SQL}
SELECT folder, page_id, name, row_number() OVER (PARTITION BY folder ORDER BY lower(name), name) AS pos
FROM listing WHERE page_id % 6 IN (0, 1, 2, 5)""",
    "list_projects": """SELECT DISTINCT c_mktsegment || '_' || c_nationkey AS name FROM customer
WHERE c_nationkey % 5 <> 0 AND contains(lower(c_mktsegment || '_' || c_nationkey), 'mach')""",
    "sync_panels_append": f"""WITH {_STOCK_SQL}
SELECT * FROM src UNION ALL SELECT project, name, 'old' FROM tgt t
WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.project = t.project AND s.name = t.name)""",
    "sync_panels_replace": f"WITH {_STOCK_SQL} SELECT * FROM src",
    "sync_diff": f"""WITH {_STOCK_SQL}
SELECT project, name, 'add' AS action FROM (SELECT project, name FROM src EXCEPT SELECT project, name FROM tgt)
UNION ALL SELECT project, name, 'keep' FROM (SELECT project, name FROM src INTERSECT SELECT project, name FROM tgt)
UNION ALL SELECT project, name, 'delete' FROM (SELECT project, name FROM tgt EXCEPT SELECT project, name FROM src)""",
    "prefer_source_path": _prefer("WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'copy/' || doc_id"),
    "prefer_source_path_strict": _prefer(""),
    "missing_artifacts": f"WITH {_ARTIFACT_SQL} SELECT * FROM required WHERE item NOT IN (SELECT item FROM present)",
    "artifact_status": f"WITH {_ARTIFACT_SQL} SELECT *, n_missing = 0 AS installed FROM status",
    "installed_only": f"""WITH {_ARTIFACT_SQL}
SELECT p_brand AS brand, p_size AS size, p_partkey AS case_id FROM part p
WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11')
  AND EXISTS (SELECT 1 FROM status s WHERE s.brand = p.p_brand AND s.size = p.p_size AND n_missing = 0)""",
    "case_matrix": """
SELECT s_suppkey AS panel, gpu, tile, c.backend AS backend, c.model AS model, c.scale AS scale
FROM supplier, (VALUES (0), (-1)) AS g(gpu), (VALUES (0), (128)) AS t(tile),
     (VALUES ('realesrgan', 'animevideov3', 2), ('realesrgan', 'animevideov3', 4), ('realesrgan', 'anime_6B', 4),
             ('realcugan', 'cugan_se', 2), ('realcugan', 'cugan_se', 4), ('span', 'span_x2_ch48', 2),
             ('span', 'span_x4_ch48', 4)) AS c(backend, model, scale)""",
    "detector_matrix": "SELECT o_orderkey AS page_id, detector FROM orders, (VALUES ('comic'), ('manga')) AS v(detector)",
    "lookup_detector": """
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2) THEN 'manga' ELSE 'comic' END AS detector,
       CASE WHEN p_partkey % 5 IN (0, 2) THEN 2 ELSE 1 END AS num_classes, 0 AS panel_class_id FROM part""",
    "lookup_variant": """
SELECT c_custkey, CAST(c_custkey % 5 AS INT) AS backend, c_nationkey AS variant, coalesce(n_name, 'unknown') AS label
FROM customer LEFT JOIN nation ON n_regionkey = c_custkey % 5 AND n_nationkey = c_nationkey""",
    "resolve_upscale": """
WITH asked AS (
  SELECT l_orderkey, l_linenumber, ['realesrgan', 'realesrgan', 'realcugan', 'span', 'realesrgan'][l_partkey % 5 + 1] AS engine,
         ['animevideov3', 'anime_6B', 'cugan_se', 'span_x2_ch48', 'span_x4_ch48', 'custom', 'x'][l_suppkey % 7 + 1] AS model,
         CAST(l_quantity AS INT) % 6 AS asked, CASE WHEN l_linenumber <> 3 THEN l_linenumber - 2 END AS gpu FROM lineitem)
SELECT l_orderkey, l_linenumber, engine, model, asked,
       CASE engine WHEN 'realesrgan' THEN CASE WHEN model = 'anime_6B' THEN 4 WHEN asked BETWEEN 2 AND 4 THEN asked ELSE 2 END
            WHEN 'span' THEN CASE model WHEN 'span_x2_ch48' THEN 2 WHEN 'span_x4_ch48' THEN 4 ELSE CASE WHEN asked = 4 THEN 4 ELSE 2 END END
            ELSE CASE WHEN asked BETWEEN 1 AND 4 THEN asked ELSE 2 END END AS scale,
       CASE WHEN engine = 'realesrgan' THEN 0 ELSE coalesce(gpu, 0) END AS gpu,
       CASE WHEN engine = 'realesrgan' AND model = 'anime_6B' THEN '4' WHEN engine = 'span' AND model = 'span_x2_ch48' THEN '2'
            WHEN engine = 'span' AND model = 'span_x4_ch48' THEN '4' WHEN engine = 'realcugan' THEN '1,2,3,4' ELSE '2,4' END AS offered
FROM asked""",
    "attach_results": f"""{views('page', 'det')},
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY name) AS page_num FROM page),
counted AS (SELECT page_id, count(*) AS boxes FROM det GROUP BY page_id)
SELECT source_id, page_num, name, n.page_id, boxes FROM numbered n JOIN counted c ON c.page_id = n.page_id""",
    "layer_settings": """
WITH base AS (SELECT c_custkey % 25 AS section, c_name AS key, c_mktsegment AS value FROM customer WHERE c_acctbal > 0),
patch AS (SELECT o_custkey % 25 AS section, printf('Customer#%09d', o_custkey) AS key,
                 CASE count(*) % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE min(o_orderpriority) END AS value FROM orders GROUP BY o_custkey),
valid AS (SELECT * FROM patch WHERE value IS NOT NULL AND NOT (key = 'Customer#000000002' AND value NOT IN ('1-URGENT', '2-HIGH'))
          AND NOT (key = 'Customer#000000005' AND value <> '1-URGENT') AND NOT (key = 'Customer#000000007' AND value NOT IN ('5-LOW', '')))
SELECT * FROM valid UNION ALL
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.section = b.section AND v.key = b.key)""",
    "build_documents": f"""{views('bubble')},{_DOC_SQL},{_PARTS_SQL}
SELECT project, part_no, CAST(p.panel_id AS VARCHAR) AS panel_id, image_path,
       CASE WHEN bubble_id IS NOT NULL THEN CAST((nth - 1) % {D.PART_SIZE} AS INT) END AS pos,
       bubble_id, x1, y1, x2, y2, raw_text, corrected_text, type, reading_order
FROM parts p LEFT JOIN cut t ON t.panel_id = p.panel_id AND t.slice = p.slice""",
    "document_json": f"""{views('bubble')},{_DOC_SQL},{_PARTS_SQL},
nested AS (SELECT panel_id, slice, list({{'bubble_id': bubble_id, 'bbox': [x1, y1, x2, y2], 'raw_text': raw_text, 'corrected_text': corrected_text,
                                         'type': type, 'reading_order': reading_order}} ORDER BY nth) AS bubbles FROM cut GROUP BY panel_id, slice)
SELECT project, part_no,
       CAST(to_json({{'project': project, 'panels': list({{'panel_id': CAST(p.panel_id AS VARCHAR), 'image_path': image_path,
            'bubbles': coalesce(bubbles, [])}} ORDER BY place)}}) AS VARCHAR) AS json
FROM parts p LEFT JOIN nested n ON n.panel_id = p.panel_id AND n.slice = p.slice GROUP BY project, part_no""",
    "bubbles_json": f"""{views('bubble')},{_DOC_SQL}
SELECT panel_id, bubble_id, '' AS raw_text, raw_text AS corrected_text, type, reading_order, x1, y1, x2, y2 FROM texts""",
    "upsert_panel": f"""{views('bubble')},{_DOC_SQL},
marked AS (SELECT *, panel_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS seen FROM panels),
shown AS (SELECT project, p.panel_id, bubble_id, CASE WHEN seen THEN 'seen' ELSE corrected_text END AS said, reading_order
          FROM marked p LEFT JOIN texts t ON t.panel_id = p.panel_id AND (NOT seen OR reading_order <= 2))
SELECT project, CAST(panel_id AS VARCHAR) AS panel_id, CAST(count(bubble_id) AS INT) AS bubbles,
       coalesce(string_agg(said, '|' ORDER BY reading_order) FILTER (WHERE bubble_id IS NOT NULL), '') AS texts
FROM shown GROUP BY project, panel_id""",
    "document_files": f"""{views('bubble')},{_DOC_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY panel_id) - 1 AS pos FROM panels),
cut AS (SELECT *, (row_number() OVER (PARTITION BY panel_id ORDER BY reading_order) - 1) // 2 AS slice FROM texts)
SELECT project, pos, CAST(coalesce(slice, 0) AS BIGINT) AS slice, CAST(p.panel_id AS VARCHAR) AS panel_id, image_path,
       CAST(count(bubble_id) AS INT) AS bubbles,
       coalesce(string_agg(corrected_text, '|' ORDER BY reading_order) FILTER (WHERE bubble_id IS NOT NULL), '') AS texts
FROM placed p LEFT JOIN cut c ON c.panel_id = p.panel_id GROUP BY project, pos, slice, p.panel_id, image_path""",
    "unknown_updates": f"""{views('bubble')},{_DOC_SQL}
SELECT project, panel_id || 'x' AS panel_id FROM panels WHERE panel_id % 4 = 0""",
    "path_names": """
WITH p AS (
  SELECT page_id, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'in/' || page_id || '.tar.GZ' WHEN 2 THEN '/in/.hidden'
         WHEN 3 THEN 'dir/' || page_id ELSE url END AS path FROM pages),
b AS (SELECT page_id, path, list_last(string_split(path, '/')) AS base FROM p),
s AS (SELECT *, CASE WHEN regexp_matches(base, '^.+[.][^.]+$') THEN regexp_replace(base, '[.][^.]+$', '') ELSE base END AS stem FROM b)
SELECT page_id, CASE WHEN stem = '' THEN 'panel' ELSE stem END AS stem, lower(regexp_extract(base, '^.+[.]([^.]+)$', 1)) AS ext,
       CASE WHEN path = '' THEN '' ELSE 'panels/' || base END AS rel_path FROM s""",
    "sanitize_names": r"""
SELECT doc_id, regexp_replace(trim('  ' || string_split(text, '.')[1] || ' -'), '[^\p{L}\p{M}\p{N}_\-]+', '_', 'g') AS project FROM documents""",
    "canonical_engine": """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'easyocr' WHEN 1 THEN 'paddle' WHEN 2 THEN 'auto' ELSE 'siliconflow' END AS ocr,
       CASE event_id % 10 WHEN 6 THEN 'realcugan' WHEN 8 THEN 'span' ELSE 'realesrgan' END AS upscale,
       CASE event_id % 10 WHEN 9 THEN 'manga' ELSE 'comic' END AS detector FROM events""",
    "repair_mojibake": "SELECT doc_id, text || '.' AS text FROM documents",
    "text_or_fallback": """
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND trim(text) <> '' THEN text ELSE 'cloud ' || turn END AS text,
       CASE WHEN turn % 4 = 0 AND trim(text) <> '' THEN 'paddle' ELSE 'siliconflow' END AS engine FROM conversations""",
    "merge_text_lines": """
WITH line AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS text FROM documents, range(1, 100000) AS g(i)
              WHERE i <= len(string_split(text, chr(10))))
SELECT doc_id, string_agg(trim(text), chr(10) ORDER BY (pos * 37) % 101, pos) AS text
FROM line WHERE pos % 7 <> 6 AND trim(text) <> '' GROUP BY doc_id""",
    "merge_text_simple": """
WITH line AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS text FROM documents, range(1, 100000) AS g(i)
              WHERE i <= len(string_split(text, chr(10))))
SELECT doc_id, trim(string_agg(trim(text), ' ' ORDER BY pos)) AS text
FROM line WHERE pos % 7 <> 6 GROUP BY doc_id""",
    "map_merge_rows": "SELECT c_custkey, c_nationkey AS a, c_nationkey + 2 AS b, 3 AS c FROM customer",
    "parse_request_lines": """
SELECT CASE WHEN k >= 4 AND event_id % 2 = 0 THEN CAST(event_id % 50 AS INT) ELSE 1 END AS page_num, 0 AS global_order_start,
       CASE WHEN k = 3 THEN 'o' WHEN k >= 4 THEN 'o' || user_id END AS output_dir, false AS use_sam,
       NOT (k >= 4 AND event_id % 2 = 1) AS reading_order, (k >= 4 AND event_id % 2 = 0) AS rtl,
       CASE WHEN k = 2 OR k >= 4 THEN event_type END AS data,
       CASE k WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'output_dir missing' WHEN 3 THEN 'image_b64 is not base64' END AS error
FROM (SELECT *, event_id % 11 AS k FROM events) WHERE k <> 0""",
}
ORACLE["document_table_upsert"] = ORACLE["upsert_panel"]
