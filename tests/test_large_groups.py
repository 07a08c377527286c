"""Groups above the limits must give what small groups give, checked against plain Python."""

import os
import random

import pytest
from brute import iou, read, smaller_share, unique, walk
from conftest import rows
from pyspark.sql import functions as F

from foliospark.operators import boxes as B
from foliospark.operators import documents as D
from foliospark.operators import order as O
from foliospark.operators import suppress as S
from foliospark.operators.layout import layout_pages, panel_manifest
from foliospark.operators.quadtree import quad_cells
from foliospark.operators.text import merge_text_lines
from foliospark.session import checkpoint_folder
from foliospark.skew import in_parts, number_rows, prefix_scan

SCHEMA = "page_id long, x1 int, y1 int, x2 int, y2 int, score int"


def random_boxes(seed, counts, spread=400, flat=False):
    rng = random.Random(seed)
    out = []
    for page, n in counts.items():
        for _ in range(n):
            x, y = rng.randrange(spread), rng.randrange(spread)
            w, h = rng.choice((5, 20, 60, 150)) + rng.randrange(20), rng.choice((5, 20, 60, 150)) + rng.randrange(20)
            if flat and rng.random() < 0.1:
                h = 0
            out.append((page, x, y, x + w, y + h, rng.randrange(1000)))
    # Exact copies, as a crowded page would have.
    return out + [b for b in out if rng.random() < 0.2]


def by_page(data):
    pages = {}
    for page, *box in data:
        pages.setdefault(page, []).append(tuple(box))
    return pages


def best_first(boxes):
    return sorted(boxes, key=lambda b: (-b[4], b[:4]))


@pytest.mark.parametrize("limit, best", [(10_000, 1), (20, 1_000), (20, 3)])
def test_greedy_walks(spark, monkeypatch, limit, best):
    monkeypatch.setattr(S, "ROUND_BEST", best)
    data = random_boxes(1, {1: 5, 2: 40, 3: 1})
    df = spark.createDataFrame(data, SCHEMA)
    cols = ("page_id", "x1", "y1", "x2", "y2", "score")
    for found, clash in (
        (S.nms(df, conf=100, limit=limit), lambda a, b: iou(a, b) > 0.45),
        (S.suppress_contained(df.where("score > 100"), limit=limit), lambda a, b: smaller_share(a, b) > 0.7),
    ):
        want = [(p, *b) for p, boxes in by_page(data).items()
                for b in walk(best_first([b for b in boxes if b[4] > 100]), clash)]
        assert rows(found, *cols) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [10_000, 20])
@pytest.mark.parametrize("rtl", [False, True])
def test_reading_order(spark, limit, rtl):
    data = random_boxes(2, {1: 4, 2: 40}, flat=True)
    found = O.cluster_rows(spark.createDataFrame(data, SCHEMA), rtl=rtl, limit=limit)
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, []).append((r.reading_order, (r.x1, r.y1, r.x2, r.y2)))
    for page, boxes in by_page(data).items():
        listed = sorted(got[page])
        assert [i for i, _ in listed] == list(range(1, len(boxes) + 1))
        assert [b for _, b in listed] == [b[:4] for b in read(boxes, rtl)]


def test_layout_matches_three_steps_and_large_pages(spark):
    df = spark.createDataFrame(random_boxes(3, {1: 6, 2: 16, 5: 2}, spread=200), SCHEMA)
    one = layout_pages(df, conf=100)
    steps = O.cluster_rows(S.suppress_contained(S.nms(df, conf=100)))
    assert rows(one) == rows(steps.select(*one.columns))
    assert rows(one) == rows(layout_pages(df, conf=100, limit=9).select(*one.columns))
    pages = spark.createDataFrame([(i, i // 4, f"{9 - i}.png") for i in range(8)], "page_id long, source_id long, name string")
    assert rows(panel_manifest(df, pages, conf=100)) == rows(panel_manifest(df, pages, conf=100, limit=9, source_limit=2))


@pytest.mark.parametrize("limit", [10_000, 10])
def test_append(spark, limit):
    rng = random.Random(4)
    schema = "panel_id long, bubble_id string, pos long, x1 int, y1 int, x2 int, y2 int, reading_order long"
    old, new = [], []
    for panel in (1, 2):
        for i in range(12 * panel):
            x, y = rng.randrange(300), rng.randrange(300)
            box = (x, y, x + 60, y + 50)
            if i % 3:
                old.append((panel, f"{panel}_b{i * 2}", i, *box, i))
            new.append((panel, None, i, box[0] + rng.randrange(40), box[1] + rng.randrange(30), box[2] + 20, box[3] + 20, None))
    out = B.append_dedup(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), limit=limit)
    got = {}
    for r in out.orderBy("pos").collect():
        got.setdefault(r.panel_id, []).append((r.bubble_id, (r.x1, r.y1, r.x2, r.y2), r.pos))
    for panel in (1, 2):
        have = [(r[1], r[3:7]) for r in old if r[0] == panel]
        for r in sorted((r for r in new if r[0] == panel), key=lambda r: r[2]):
            if any(iou(k, r[3:7]) >= 0.45 for _, k in have):
                continue
            n = len(have) + 1
            while f"{panel}_b{n}" in {i for i, _ in have}:
                n += 1
            have.append((f"{panel}_b{n}", r[3:7]))
        assert [(i, b) for i, b, _ in got[panel]] == have
        assert [p for *_, p in got[panel]] == list(range(1, len(have) + 1))


def test_new_boxes_only_large(spark):
    data = spark.createDataFrame(random_boxes(5, {1: 40, 2: 3}), SCHEMA)
    data = number_rows(data, "page_id", [-F.col("score"), "x1", "y1", "x2", "y2"], "pos")
    new, old = data.where("pos % 2 = 0"), data.where("pos % 2 = 1")
    small = B.new_boxes_only(new, old, by="page_id")
    assert rows(small) == rows(B.new_boxes_only(new, old, by="page_id", limit=4, cell=64).select(*small.columns))


def test_prefix_scan_slices(spark):
    rng = random.Random(6)
    data = [(k, i, rng.randrange(50)) for k, n in (("a", 500), ("b", 3), (None, 40)) for i in range(n)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i long, v long")
    plain = prefix_scan(df, "k", ["i"], rank="r", totals={"t": F.col("v")})
    sliced = prefix_scan(df, "k", [F.col("i")], rank="r", totals={"t": F.col("v")}, limit=20)
    assert rows(plain) == rows(sliced)
    down = number_rows(df, "k", [F.desc("i")], "r", limit=20)
    assert {(r.k, r.i + r.r) for r in down.collect()} == {("a", 500), ("b", 3), (None, 40)}


def test_neighbors_large(spark):
    df = spark.createDataFrame([(g, i) for g, n in ((1, 60), (2, 2)) for i in range(n)], "g long, item_id long")
    assert rows(O.neighbors(df, "g", order=["item_id"])) == rows(O.neighbors(df, "g", order=["item_id"], limit=10))


@pytest.mark.parametrize("limit", [10_000, 15])
def test_unique_ids(spark, limit):
    rng = random.Random(7)
    stems = ["a", "a_2", "a", "a", "a_3", "a_2", "a_2_2", "", "panel", "b_2", "b", "b", "c_01", "c", "c"]
    lists = {0: stems, 1: ["a", "a_2", "a"], 2: ["x", "y"]}
    for k in range(3, 9):
        lists[k] = [rng.choice("ab") + "".join(rng.choice(("", "_2", "_3", "_2_2", "_1")) for _ in range(2)) for _ in range(40)]
    data = [(k, i, s) for k, items in lists.items() for i, s in enumerate(items)]
    out = O.unique_ids(spark.createDataFrame(data, "k long, pos long, stem string"), "k", limit=limit)
    got = {}
    for r in out.orderBy("pos").collect():
        got.setdefault(r.k, []).append(r.panel_id)
    assert got == {k: unique(items) for k, items in lists.items()}
    assert got[1] == ["a", "a_2", "a_3"]


def test_document_parts(spark):
    panels = spark.createDataFrame([("p", i, f"panels/{i}.png", i) for i in range(7)] + [("q", 100, "panels/q.png", 0)],
                                   "project string, panel_id long, image_path string, pos long")
    bubbles = spark.createDataFrame(
        [(p, f"{p}_b{i}", i, 0, 0, 9, 9, "t", "t", "speech") for p in (1, 100) for i in range(1, 8)],
        "panel_id long, bubble_id string, reading_order long, x1 int, y1 int, x2 int, y2 int, raw_text string, corrected_text string, type string")
    cut = D.build_documents(panels, bubbles, part_size=3)
    assert cut.groupBy("project").count().orderBy("project").collect() == [("p", 3), ("q", 1)]
    assert all(len(p.panels) <= 3 and all(len(x.bubbles) <= 3 for x in p.panels) for p in cut.collect())
    cols = ["project", "panel_id", "bubble_id", "reading_order", "raw_text"]
    whole = D.build_documents(panels, bubbles)
    assert whole.count() == 2
    assert rows(D.explode_bubbles(whole), *cols) == rows(D.explode_bubbles(cut), *cols)


def test_text_parts(spark):
    lines = spark.createDataFrame([(1, i, (i * 7) % 50, f" l{i} ") for i in range(50)] + [(2, 0, 1, "x")],
                                  "doc_id long, pos long, y long, text string")
    whole = {r.doc_id: r.text for r in merge_text_lines(lines).collect()}
    whole = {r.doc_id: r.text for r in merge_text_lines(lines).collect()}
    parts = merge_text_lines(lines, part_size=8).collect()
    assert len(parts) == 2 and {r.doc_id: r.text for r in parts} == whole
    assert in_parts(lines, "doc_id", ["pos"], "n", size=8).where("doc_id = 1").groupBy("n").count().agg(F.max("count")).first()[0] == 8


def test_overlap_pairs_large(spark):
    data = spark.createDataFrame(random_boxes(8, {1: 40, 2: 3}), SCHEMA)
    data = number_rows(data, "page_id", [-F.col("score"), "x1", "y1", "x2", "y2"], "det_id")
    for metric, threshold in (("iou", 0.2), ("min", 0.5)):
        plain = B.overlap_pairs(data, metric=metric, threshold=threshold)
        assert plain.count() > 10
        assert rows(plain) == rows(B.overlap_pairs(data, metric=metric, threshold=threshold, limit=5, cell=64))


@pytest.mark.parametrize("limit", [None, 6])
def test_snap_to_edges_brute(spark, limit):
    rng = random.Random(11)
    schema = "page_id int, box_id int, x1 int, y1 int, x2 int, y2 int"
    boxes = [(p, b, x, y, x + rng.randrange(60), y + rng.randrange(60)) for p, n in ((1, 40), (2, 3), (3, 1)) for b in range(n)
             for x, y in [(rng.randrange(150), rng.randrange(150))]]
    boxes += [(1, 90, 20, 20, 20, 20), (1, 91, 20, 20, 20, 20), (1, None, 131, 7, 140, 9), (None, 5, 1, 1, 2, 2), (9, 1, 3, 3, 5, 5)]
    sizes = {1: (210, 210), 2: (100, 90), 3: (40, 40), 4: (5, 5)}
    moved = [(p, b, x + rng.randrange(-6, 7), y + rng.randrange(-6, 7), x2, y2) for p, b, x, y, x2, y2 in boxes]

    def axis(p, b, lo, hi, size, at):
        marks = ([0, size] if size is not None else []) + [v for q in boxes if q[0] == p and q[1] != b for v in (q[2 + at], q[4 + at])]
        found = [(abs(m - e), k, m, m - k * (hi - lo)) for m in marks for k, e in ((0, lo), (1, hi)) if abs(m - e) <= 8]
        return min(found)[3] if found else lo

    want = []
    for p, b, x1, y1, x2, y2 in moved:
        w, h = sizes.get(p, (None, None))
        x, y = (x1, y1) if p is None or b is None else (axis(p, b, x1, x2, w, 0), axis(p, b, y1, y2, h, 1))
        want.append((p, b, x, y, x + x2 - x1, y + y2 - y1))
    out = B.snap_to_edges(spark.createDataFrame(moved, schema), spark.createDataFrame(boxes, schema),
                          spark.createDataFrame([(p, *s) for p, s in sizes.items()], "page_id int, w int, h int"), limit=limit)
    assert rows(out, "page_id", "box_id", "x1", "y1", "x2", "y2") == sorted(want, key=repr)


def test_quad_cells(spark):
    rng = random.Random(2)
    # A crowd in one corner, a box over the whole page, a pile of copies, a null corner, negative coordinates.
    data = [(1, x, y, x + 4, y + 4) for _ in range(300) for x, y in [(rng.randrange(64), rng.randrange(64))]]
    data += [(1, 0, 0, 1000, 1000), (2, -70, -5, -30, 12), (2, None, 1, 2, 3)] + [(3, 500, 500, 540, 540)] * 50
    df = spark.createDataFrame(data, "page_id int, x1 int, y1 int, x2 int, y2 int")
    out = quad_cells(df, ["page_id"], room=10).collect()
    sides = {p: {r._side for r in out if r.page_id == p} for p in (1, 2, 3)}
    assert min(sides[1]) < 64 < max(sides[1]) and sides[2] == {1024.0} and min(sides[3]) >= 32
    for r in out:
        for a, g in ((r.x1, r._gx), (r.y1, r._gy)):
            assert a < (g + 1) * r._side
        assert r.x2 >= r._gx * r._side and r.y2 >= r._gy * r._side
    # Leaves do not overlap: the corner of every box is in exactly one of its cells.
    homes = {}
    for r in out:
        if r.x1 // r._side == r._gx and r.y1 // r._side == r._gy:
            homes[(r.page_id, r.x1, r.y1, r.x2)] = homes.get((r.page_id, r.x1, r.y1, r.x2), 0) + 1
    assert sum(homes.values()) == len(data) - 1
    assert quad_cells(df.where("page_id = 9"), ["page_id"]).count() == 0


@pytest.mark.parametrize("room", [3, 1000])
def test_cells_change_no_result(spark, room):
    data = spark.createDataFrame(random_boxes(21, {1: 120, 2: 3}, spread=200), SCHEMA)
    data = number_rows(data, "page_id", [-F.col("score"), "x1", "y1", "x2", "y2"], "det_id")
    plain = B.overlap_pairs(data, threshold=0.1, limit=None)
    assert plain.count() > 50 and rows(plain) == rows(B.overlap_pairs(data, threshold=0.1, limit=5, room=room))
    new, old = data.where("det_id % 2 = 0"), data.where("det_id % 2 = 1")
    small = B.new_boxes_only(new, old, by="page_id", limit=None)
    assert 0 < small.count() < new.count()
    assert rows(small) == rows(B.new_boxes_only(new, old, by="page_id", limit=4, room=room).select(*small.columns))


def folder_bytes(spark):
    path = checkpoint_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_snap_in_slices_writes_little(spark):
    """Lines cut by slices snap as whole ones do: crowds of one owner, piles on one spot, lone marks far off."""
    rng = random.Random(5)
    data = [(p, b if p % 3 else b % 2, x, y, x + rng.randrange(1, 40), y + rng.randrange(1, 40)) for p in range(12) for b in range(400)
            for x, y in [(rng.randrange(2000) if p % 2 else 40 * (b % 7 == 0), rng.randrange(4000))]]
    data += [(20, 1, 5 * k, 7, 5 * k + 1, 9) for k in range(800)] + [(20, 2, 2000, 7, 2003, 9)]
    boxes = spark.createDataFrame(data, "page_id int, box_id int, x1 int, y1 int, x2 int, y2 int")
    pages = spark.createDataFrame([(p, 2500, 4500) for p in range(0, 25, 2)], "page_id int, w int, h int")
    before = folder_bytes(spark)
    cut = rows(B.snap_to_edges(boxes, boxes, pages, limit=6))
    assert folder_bytes(spark) - before < 100 * len(data)
    assert cut == rows(B.snap_to_edges(boxes, boxes, pages))


def test_large_pages_are_derived_once(spark):
    """Suppression stores the boxes of large pages before its tests name them: one more pass over what they derive from."""
    seen = spark.sparkContext.accumulator(0)
    data = [(p, 9 * b, 3 * p, 9 * b + 12, 3 * p + 5, b) for p in range(3) for b in range(40)]

    def counted(batches):
        for rows_ in batches:
            seen.add(len(rows_))
            yield rows_

    boxes = spark.createDataFrame(data, SCHEMA)
    assert rows(S.nms(boxes.mapInPandas(counted, boxes.schema), conf=None, limit=6)) == rows(S.nms(boxes, conf=None))
    # Read twice for the counts of their pages, once to be stored, and once for the ordinary pages.
    assert seen.value <= 4 * len(data)


def test_pairs_of_large_pages_derive_boxes_once(spark):
    """Boxes are counted, then joined with the large pages and stored; ordinary pages and cells read what is stored."""
    seen = spark.sparkContext.accumulator(0)
    data = [(p, 10 * p + b, 9 * b, 9 * b % 50, 9 * b + 12, 60) for p in range(4) for b in range(3 + 20 * (p % 2))]
    boxes = spark.createDataFrame(data, "page_id int, det_id int, x1 int, y1 int, x2 int, y2 int")

    def counted(batches):
        for rows_ in batches:
            seen.add(len(rows_))
            yield rows_

    found = rows(B.overlap_pairs(boxes.mapInPandas(counted, boxes.schema), threshold=0.05, limit=6, room=4))
    assert found == rows(B.overlap_pairs(boxes, threshold=0.05)) and len(found) > 40
    assert seen.value <= 3 * len(data)
