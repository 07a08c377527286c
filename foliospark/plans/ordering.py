"""Reading order, numbering, order editing and appended bubbles."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.names import export_filename, file_stem, panel_filename
from foliospark.operators import boxes as B
from foliospark.operators import order as O
from foliospark.operators.layout import panel_manifest as manifest
from foliospark.plans.check_sql import CONTAINED, IOU_ABOVE, IOU_REACHES, greedy, row_walk, views
from foliospark.plans.detection import DET, RANK
from foliospark.plans.fixtures import Tables

_CENTRE = "y1 + y2, x1, y1, x2, y2, score, class_id"
_BUBBLE = ["bubble_id", "pos", "x1", "y1", "x2", "y2"]


def _strong(t: Tables):
    return B.filter_score(t.det(), conf=350)


def cluster_rows(spark, d):
    return O.cluster_rows(_strong(Tables(spark, d)))


def cluster_rows_large_pages(spark, d):
    """The way of pages too large for one array, taken by every page above six boxes."""
    return O.cluster_rows(_strong(Tables(spark, d)), limit=6)


def cluster_rows_rtl(spark, d):
    return O.cluster_rows(_strong(Tables(spark, d)), rtl=True)


def panel_manifest(spark, d):
    t = Tables(spark, d)
    return manifest(t.det(), t.page(), conf=350)


def sort_boxes(spark, d):
    return O.sort_boxes(Tables(spark, d).det()).drop("class_id")


def top_score(spark, d):
    return O.top_score(Tables(spark, d).det()).drop("class_id")


def limit_n(spark, d):
    return O.limit_n(Tables(spark, d).page(), 100, [F.lower("name"), "page_id"])


def number_pages(spark, d):
    return O.number_pages(Tables(spark, d).page())


def _ordered_panels(t: Tables):
    return O.sort_boxes(t.det()).withColumn("reading_order", F.col("box_no")).select("page_id", "reading_order", "x1", "y1")


def global_order(spark, d):
    t = Tables(spark, d)
    return O.global_order(_ordered_panels(t), t.page())


def global_order_large_sources(spark, d):
    """Numbering sliced inside the source, for every source above eight pages."""
    t = Tables(spark, d)
    return O.global_order(_ordered_panels(t), t.page(), limit=8)


def panel_ids(spark, d):
    t = Tables(spark, d)
    numbered = O.global_order(_ordered_panels(t), t.page())
    gaps = numbered.withColumn("reading_order", F.when(F.col("x1") % 5 == 0, F.lit(0)).when(F.col("x1") % 7 != 0, F.col("reading_order")))
    return O.panel_ids(gaps).select("source_id", "page_id", "global_order", "panel_id", "panel_num")


def export_names(spark, d):
    t = Tables(spark, d)
    numbered = O.global_order(_ordered_panels(t), t.page()).join(t.page().select("page_id", "name"), "page_id")
    pid = F.format_string("p%03d", "reading_order")
    return numbered.select("page_id", "global_order", panel_filename("global_order", "page_num", "reading_order").alias("file_name"),
                           export_filename("reading_order", pid).alias("export_name"),
                           export_filename("reading_order", pid, file_stem("name")).alias("flat_name"))


def _sparse(t: Tables):
    return (t.bubble().where("pos <> 1").withColumn("reading_order", F.expr("CASE WHEN pos % 3 <> 0 THEN (pos * 5) % 7 - 1 END"))
            .select("panel_id", "bubble_id", "pos", "reading_order"))


def fill_orders(spark, d):
    return O.fill_orders(_sparse(Tables(spark, d)), "panel_id")


def normalize_orders(spark, d):
    return O.normalize_orders(_sparse(Tables(spark, d)), "panel_id")


def assign_reading_order(spark, d):
    bubbles = Tables(spark, d).bubble().withColumn("reading_order", F.expr("CASE WHEN panel_id % 3 = 0 THEN pos + 1 ELSE reading_order END"))
    return O.assign_reading_order(bubbles).drop("raw_text")


def move_item(spark, d):
    items = _sparse(Tables(spark, d))
    moves = items.where("pos = 2").selectExpr(
        "panel_id", "bubble_id", "CASE WHEN panel_id % 3 = 0 THEN 3 WHEN panel_id % 3 = 1 THEN 99 END AS to",
        "CASE WHEN panel_id % 3 = 2 THEN -1 END AS delta")
    return O.move_item(items, moves, "panel_id", item="bubble_id")


def neighbors(spark, d):
    return O.neighbors(Tables(spark, d).page().select("source_id", "page_id", "name"), "source_id", item="page_id", order=["name"])


def unique_ids(spark, d):
    parts = Tables(spark, d).read("part").selectExpr("p_size AS folder", "p_partkey AS pos", "replace(p_name, ' ', '_') AS stem")
    return O.unique_ids(parts, "folder")


def unique_ids_colliding(spark, d):
    parts = Tables(spark, d).read("part").selectExpr(
        "p_brand AS folder", "p_partkey AS pos",
        "concat(element_at(array('a', 'b', 'scan'), CAST(p_partkey % 3 + 1 AS INT)), CASE WHEN p_partkey % 7 = 0 THEN '_2' "
        "WHEN p_partkey % 11 = 0 THEN '_4' WHEN p_partkey % 13 = 0 THEN '_3_2' ELSE '' END) AS stem")
    return O.unique_ids(parts, "folder")


def _even_ids(t: Tables):
    return t.bubble().withColumn("bubble_id", F.concat("panel_id", F.lit("_b"), (F.col("pos") * 2).cast("string")))


def next_bubble_id(spark, d):
    return O.next_bubble_id(_even_ids(Tables(spark, d)))


def _found(t: Tables):
    right, down = "CAST((pos * 37 + panel_id * 11) % 90 AS INT)", "CAST((pos * 13) % 25 AS INT)"
    return t.bubble().selectExpr(
        "panel_id", "pos", f"x1 + {right} AS x1", f"y1 + {down} AS y1", f"x2 + {right} AS x2", f"y2 + {down} AS y2")


def append_dedup(spark, d):
    t = Tables(spark, d)
    return B.append_dedup(_even_ids(t), _found(t), reorder=False).drop("pos")


def append_reordered(spark, d):
    t = Tables(spark, d)
    return B.append_dedup(_even_ids(t), _found(t), reorder=True).drop("pos")


def replace_boxes(spark, d):
    t = Tables(spark, d)
    return B.append_dedup(_even_ids(t), _found(t), mode="replace").drop("pos")


_SORTED = """
boxed AS (SELECT page_id, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, x2, y2) AS reading_order FROM det),
counted AS (SELECT p.page_id, p.source_id, p.name, (SELECT count(*) FROM det d WHERE d.page_id = p.page_id) AS n FROM page p),
numbered AS (SELECT page_id, source_id, name, row_number() OVER s AS page_num,
                    coalesce(sum(n) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM counted WINDOW s AS (PARTITION BY source_id ORDER BY name)),
placed AS (SELECT b.*, n.source_id, n.name, n.page_num, CAST(n.before + b.reading_order AS BIGINT) AS global_order
           FROM boxed b JOIN numbered n ON n.page_id = b.page_id)"""

_SPARSE = """
sparse AS (SELECT panel_id, bubble_id, pos, CASE WHEN pos % 3 <> 0 THEN (pos * 5) % 7 - 1 END AS reading_order
           FROM bubble WHERE pos <> 1)"""
_FILLED = f"""{_SPARSE},
gap AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY pos) AS r FROM sparse
        WHERE reading_order IS NULL OR reading_order <= 0),
free AS (SELECT panel_id, n, row_number() OVER (PARTITION BY panel_id ORDER BY n) AS r
         FROM (SELECT DISTINCT panel_id FROM sparse) q, range(1, 40) AS g(n)
         WHERE NOT EXISTS (SELECT 1 FROM sparse s WHERE s.panel_id = q.panel_id AND s.reading_order = n)),
filled AS (SELECT panel_id, bubble_id, pos, reading_order FROM sparse WHERE reading_order > 0
           UNION ALL SELECT g.panel_id, g.bubble_id, g.pos, f.n FROM gap g JOIN free f ON f.panel_id = g.panel_id AND f.r = g.r)"""

_UNIQUE = """
list AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY pos) AS rk FROM stems),
walk AS (
  SELECT folder, rk, pos, stem, stem AS panel_id, [stem] AS used FROM list WHERE rk = 1
  UNION ALL
  SELECT folder, rk, pos, stem, pid, list_append(used, pid)
  FROM (SELECT l.*, w.used, CASE WHEN NOT list_contains(w.used, l.stem) THEN l.stem ELSE l.stem || '_' ||
               list_filter(range(2, len(w.used) + 3), lambda n: NOT list_contains(w.used, l.stem || '_' || n))[1] END AS pid
        FROM walk w JOIN list l ON l.folder = w.folder AND l.rk = w.rk + 1))
SELECT folder, pos, stem, panel_id FROM walk"""

_EVEN = """
even AS (SELECT panel_id, panel_id || '_b' || (pos * 2) AS bubble_id, pos, reading_order, x1, y1, x2, y2 FROM bubble),
found AS (SELECT panel_id, pos, CAST(x1 + (pos * 37 + panel_id * 11) % 90 AS INT) AS x1, CAST(y1 + (pos * 13) % 25 AS INT) AS y1,
                 CAST(x2 + (pos * 37 + panel_id * 11) % 90 AS INT) AS x2, CAST(y2 + (pos * 13) % 25 AS INT) AS y2
          FROM bubble)"""
_FREE_IDS = """
size AS (SELECT panel_id, count(*) AS n FROM even GROUP BY panel_id),
open_id AS (SELECT s.panel_id, g.n, row_number() OVER (PARTITION BY s.panel_id ORDER BY g.n) AS r
            FROM size s, range(1, 60) AS g(n)
            WHERE g.n > s.n AND NOT EXISTS (SELECT 1 FROM even e WHERE e.panel_id = s.panel_id AND e.bubble_id = s.panel_id || '_b' || g.n))"""
_APPENDED = f"""{_EVEN},{_FREE_IDS},
both_sets AS (SELECT panel_id, 0 AS fresh, bubble_id, pos, x1, y1, x2, y2 FROM even
              UNION ALL SELECT panel_id, 1, '', pos, x1, y1, x2, y2 FROM found),
{greedy('kept', 'both_sets', 'panel_id', ['fresh'] + _BUBBLE, 'fresh, pos, x1, y1, x2, y2', IOU_REACHES, 'r.fresh = 0')},
fresh_kept AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY pos) AS r FROM kept WHERE fresh = 1),
appended AS (
  SELECT panel_id, bubble_id, row_number() OVER (PARTITION BY panel_id ORDER BY pos) AS pos, x1, y1, x2, y2, reading_order FROM even
  UNION ALL
  SELECT f.panel_id, f.panel_id || '_b' || o.n, s.n + f.r, f.x1, f.y1, f.x2, f.y2, s.n + f.r
  FROM fresh_kept f JOIN size s ON s.panel_id = f.panel_id JOIN open_id o ON o.panel_id = f.panel_id AND o.r = f.r)"""


def _assigned(source: str, cols: list[str]) -> str:
    return f"""
complete AS (SELECT panel_id FROM {source} GROUP BY panel_id HAVING count(*) = count(reading_order)),
partial AS (SELECT * FROM {source} WHERE panel_id NOT IN (SELECT panel_id FROM complete)),
{row_walk('ranked', 'partial', 'panel_id', cols, 'y1 + y2, pos')}
SELECT panel_id, {', '.join(c for c in cols if c != 'pos')}, reading_order FROM ranked
UNION ALL SELECT panel_id, {', '.join(c for c in cols if c != 'pos')}, reading_order FROM {source}
WHERE panel_id IN (SELECT panel_id FROM complete)"""


QUERIES = {f.__name__: f for f in (
    panel_manifest, cluster_rows, cluster_rows_large_pages, cluster_rows_rtl, sort_boxes, top_score, limit_n, number_pages, global_order,
    global_order_large_sources, panel_ids,
    export_names, fill_orders, normalize_orders, assign_reading_order, move_item, neighbors, unique_ids,
    unique_ids_colliding, next_bubble_id, append_dedup, append_reordered, replace_boxes)}

ORACLE = {
    "panel_manifest": f"""{views('det', 'page', recursive=True)}, strong AS (SELECT * FROM det WHERE score > 350),
{greedy('spread_out', 'strong', 'page_id', DET, RANK, IOU_ABOVE)},
{greedy('outer_boxes', 'spread_out', 'page_id', DET, RANK, CONTAINED)},
{row_walk('panel', 'outer_boxes', 'page_id', DET, _CENTRE)},
counted AS (SELECT p.page_id, p.source_id, p.name, coalesce(c.n, 0) AS n FROM page p
            LEFT JOIN (SELECT page_id, count(*) AS n FROM panel GROUP BY page_id) c ON c.page_id = p.page_id),
numbered AS (SELECT page_id, source_id, row_number() OVER s AS page_num,
                    coalesce(sum(n) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM counted WINDOW s AS (PARTITION BY source_id ORDER BY name))
SELECT p.*, n.source_id, n.page_num, CAST(n.before + p.reading_order AS BIGINT) AS global_order,
       p.reading_order AS panel_num, printf('p%03d', p.reading_order) AS panel_id,
       printf('%03d_page_%03d_panel_%02d.png', CAST(n.before + p.reading_order AS BIGINT), n.page_num, p.reading_order) AS file_name
FROM panel p JOIN numbered n ON n.page_id = p.page_id""",
    "cluster_rows": f"""{views('det', recursive=True)}, strong AS (SELECT * FROM det WHERE score > 350),
{row_walk('panel', 'strong', 'page_id', DET, _CENTRE)} SELECT * FROM panel""",
    "cluster_rows_rtl": f"""{views('det', recursive=True)}, strong AS (SELECT * FROM det WHERE score > 350),
{row_walk('panel', 'strong', 'page_id', DET, _CENTRE, rtl=True)} SELECT * FROM panel""",
    "sort_boxes": f"""{views('det')} SELECT page_id, x1, y1, x2, y2, score,
       row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, x2, y2, score) AS box_no FROM det""",
    "top_score": f"""{views('det')} SELECT page_id, x1, y1, x2, y2, score FROM det
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, x1, y1, x2, y2) = 1""",
    "limit_n": f"{views('page')} SELECT * FROM page ORDER BY lower(name), page_id LIMIT 100",
    "number_pages": f"{views('page')} SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY name) AS page_num FROM page",
    "global_order": f"""{views('det', 'page')},{_SORTED}
SELECT page_id, reading_order, x1, y1, source_id, page_num, global_order FROM placed""",
    "panel_ids": f"""{views('det', 'page')},{_SORTED},
gaps AS (SELECT *, CASE WHEN x1 % 5 = 0 THEN 0 WHEN x1 % 7 <> 0 THEN reading_order END AS ro FROM placed)
SELECT source_id, page_id, global_order, CASE WHEN ro IS NULL THEN 'pnull' ELSE printf('p%03d', ro) END AS panel_id,
       coalesce(nullif(ro, 0), global_order) AS panel_num FROM gaps""",
    "export_names": f"""{views('det', 'page')},{_SORTED}
SELECT page_id, global_order, printf('%03d_page_%03d_panel_%02d.png', global_order, page_num, reading_order) AS file_name,
       printf('%03d_p%03d_panel.png', reading_order, reading_order) AS export_name,
       printf('%s_%03d_p%03d_panel.png', replace(name, '.png', ''), reading_order, reading_order) AS flat_name FROM placed""",
    "fill_orders": f"{views('bubble')},{_FILLED} SELECT * FROM filled",
    "normalize_orders": f"""{views('bubble')},{_FILLED}
SELECT panel_id, bubble_id, pos, row_number() OVER (PARTITION BY panel_id ORDER BY reading_order, pos) AS reading_order FROM filled""",
    "assign_reading_order": f"""{views('bubble', recursive=True)},
asked AS (SELECT panel_id, bubble_id, pos, x1, y1, x2, y2, CASE WHEN panel_id % 3 = 0 THEN pos + 1 ELSE reading_order END AS reading_order
          FROM bubble),
complete AS (SELECT panel_id FROM asked GROUP BY panel_id HAVING count(*) = count(reading_order)),
partial AS (SELECT * FROM asked WHERE panel_id NOT IN (SELECT panel_id FROM complete)),
{row_walk('ranked', 'partial', 'panel_id', _BUBBLE, 'y1 + y2, pos')}
SELECT panel_id, bubble_id, pos, x1, y1, x2, y2, reading_order FROM ranked
UNION ALL SELECT panel_id, bubble_id, pos, x1, y1, x2, y2, reading_order FROM asked WHERE panel_id IN (SELECT panel_id FROM complete)""",
    "move_item": f"""{views('bubble')},{_FILLED},
listed AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY reading_order, pos) AS i,
                  count(*) OVER (PARTITION BY panel_id) AS n FROM filled),
goal AS (SELECT panel_id, bubble_id AS item, reading_order AS old_no,
                CASE panel_id % 3 WHEN 0 THEN least(n, 3) WHEN 1 THEN n ELSE i - 1 END AS new_no
         FROM listed WHERE pos = 2),
valid AS (SELECT * FROM goal WHERE new_no >= 1 AND new_no <> old_no),
moved AS (
  SELECT l.panel_id, l.bubble_id, l.pos, l.reading_order, l.i, v.item,
         CASE WHEN l.bubble_id = v.item THEN v.new_no
              WHEN v.old_no < v.new_no AND l.reading_order > v.old_no AND l.reading_order <= v.new_no THEN l.reading_order - 1
              WHEN v.old_no > v.new_no AND l.reading_order >= v.new_no AND l.reading_order < v.old_no THEN l.reading_order + 1
              ELSE l.reading_order END AS shifted
  FROM listed l LEFT JOIN valid v ON v.panel_id = l.panel_id)
SELECT panel_id, bubble_id, pos, CASE WHEN item IS NULL THEN reading_order
       ELSE row_number() OVER (PARTITION BY panel_id ORDER BY shifted, i) END AS reading_order FROM moved""",
    "neighbors": f"""{views('page')}
SELECT source_id, page_id, name, lag(page_id) OVER s AS prev_item, lead(page_id) OVER s AS next_item,
       row_number() OVER s AS index, count(*) OVER (PARTITION BY source_id) AS total
FROM page WINDOW s AS (PARTITION BY source_id ORDER BY name)""",
    "unique_ids": f"""WITH RECURSIVE
stems AS (SELECT p_size AS folder, p_partkey AS pos, replace(p_name, ' ', '_') AS stem FROM part),{_UNIQUE}""",
    "unique_ids_colliding": f"""WITH RECURSIVE
stems AS (SELECT p_brand AS folder, p_partkey AS pos,
                 ['a', 'b', 'scan'][p_partkey % 3 + 1] || CASE WHEN p_partkey % 7 = 0 THEN '_2' WHEN p_partkey % 11 = 0 THEN '_4'
                 WHEN p_partkey % 13 = 0 THEN '_3_2' ELSE '' END AS stem FROM part),{_UNIQUE}""",
    "next_bubble_id": f"""{views('bubble')},{_EVEN},{_FREE_IDS}
SELECT panel_id, panel_id || '_b' || n AS next_id FROM open_id WHERE r = 1""",
    "append_dedup": f"""{views('bubble', recursive=True)},{_APPENDED}
SELECT panel_id, bubble_id, x1, y1, x2, y2, reading_order FROM appended""",
    "append_reordered": f"""{views('bubble', recursive=True)},{_APPENDED},{_assigned('appended', _BUBBLE)}""",
    "replace_boxes": f"""{views('bubble')},{_EVEN},
ranked AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY pos) AS reading_order FROM found)
SELECT panel_id, panel_id || '_b' || reading_order AS bubble_id, x1, y1, x2, y2, reading_order FROM ranked""",
}

# The ways for large groups answer to the same check.
ORACLE["cluster_rows_large_pages"] = ORACLE["cluster_rows"]
ORACLE["global_order_large_sources"] = ORACLE["global_order"]
