"""Totals, timing and quality reports; every one is a combinable aggregate over its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.text import strip
from foliospark.session import cut_lineage
from foliospark.skew import names, number_rows


def source_totals(pages: DataFrame, panels: DataFrame, *, source: str = "source_id", page: str = "page_id") -> DataFrame:
    """Pages and panels per source; ``pages`` may carry ``failed``, whose pages count no panels."""
    counts = panels.groupBy(page).agg(F.count(F.lit(1)).alias("_n"))
    joined = pages.join(counts, page, "left")
    ok = ~F.col("failed") if "failed" in pages.columns else F.lit(True)
    return joined.groupBy(source).agg(
        F.count(page).alias("pages_processed"),
        F.sum(F.when(ok, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0))).alias("panels_total"))


def stage_stats(panels: DataFrame, bubbles: DataFrame, *, project: str = "project") -> DataFrame:
    """Readable panels, bubbles, detector and text times, and unreadable panels per project.

    ``panels``: project, panel_id, readable, detector_ms; ``bubbles``: panel_id, ocr_ms.
    The names of unreadable panels are the rows of :func:`stage_errors`.
    """
    per_panel = bubbles.groupBy("panel_id").agg(F.count(F.lit(1)).alias("_b"), F.sum("ocr_ms").alias("_ms"))
    ok = F.col("readable")
    joined = panels.join(per_panel, "panel_id", "left")
    return joined.groupBy(project).agg(
        F.count_if(ok).alias("panels"),
        F.sum(F.when(ok, F.coalesce("_b", F.lit(0))).otherwise(0)).alias("bubbles"),
        F.sum(F.when(ok, F.coalesce("detector_ms", F.lit(0))).otherwise(0)).alias("detector_ms"),
        F.sum(F.when(ok, F.coalesce("_ms", F.lit(0))).otherwise(0)).alias("ocr_ms"),
        F.count_if(~ok).alias("errors"))


def stage_errors(panels: DataFrame, *, project: str = "project") -> DataFrame:
    """Panels that could not be read."""
    return panels.where("NOT readable").select(project, "panel_id")


# The steps of a page run and its time limit in milliseconds.
STEPS = ("yolo_ms", "sam_encoder_ms", "sam_decoder_ms", "total_ms")
PAGE_LIMIT_MS = 600.0


def benchmark_rows(
    runs: DataFrame, *, by: Sequence[str] = ("file", "mode"), timings: str = "timings", steps: Sequence[str] = STEPS,
    limit_ms: float = PAGE_LIMIT_MS,
) -> DataFrame:
    """Mean of each step over all repeats (a missing step counts 0), rounded to 0.1, and the pass flag."""
    mean = {s: F.sum(F.coalesce(F.try_element_at(timings, F.lit(s)), F.lit(0.0))) / F.count(F.lit(1)) for s in steps}
    out = runs.groupBy(*by).agg(*[m.alias(f"_{s}") for s, m in mean.items()])
    return out.select(*by, *[F.bround(f"_{s}", 1).alias(s) for s in steps],
                      (F.col("_total_ms") < limit_ms).alias("passes"))


def benchmark_summary(rows: DataFrame, *, by: str | Sequence[str] = "mode", error: str | None = None) -> DataFrame:
    """Per mode: mean total, passed and counted rows; rows with an error are left out."""
    good = rows.where(F.col(error).isNull()) if error else rows
    return good.groupBy(*names(by)).agg(F.avg("total_ms").alias("avg_total_ms"), F.count_if("passes").alias("passed"),
                                        F.count(F.lit(1)).alias("files"))


def bubble_texts(bubbles: DataFrame, *, text: str = "raw_text") -> DataFrame:
    """Length and an 80-character preview of the trimmed text of each bubble."""
    clean = strip(F.coalesce(text, F.lit("")))
    return bubbles.withColumns({"text_len": F.length(clean), "text_preview": F.substring(clean, 1, 80)})


def ocr_report(bubbles: DataFrame, *, panel: str = "panel_id", text: str = "raw_text", error: str | None = None) -> DataFrame:
    """Bubbles and empty texts per panel, and in the row with a null panel for all of them."""
    good = bubbles.where(F.col(error).isNull()) if error else bubbles
    clean = strip(F.coalesce(text, F.lit("")))
    return good.rollup(panel).agg(F.count(F.lit(1)).alias("bubbles"), F.count_if(F.length(clean) == 0).alias("empty_ocr"))


def seam_score(grid: DataFrame, *, by: str | Sequence[str] = "image", block: int = 64) -> DataFrame:
    """Mean jump across block boundaries of a value grid (``x, y, value``), null below two blocks.

    Only the two rows or columns at a boundary are kept, and each pair is put together by an
    aggregate, so neither a window over an image nor a self-join is needed.
    """
    by = names(by)
    size = grid.groupBy(*by).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))

    def seams(axis: str, along: str) -> DataFrame:
        at = F.col(axis)
        near = grid.where(((at % block == 0) & (at > 0)) | (at % block == block - 1))
        seam = F.floor((at + 1) / block).cast("long")
        pair = near.groupBy(*by, seam.alias("_seam"), along).agg(
            F.max(F.when(at % block == 0, F.col("value"))).alias("_after"),
            F.max(F.when(at % block == block - 1, F.col("value"))).alias("_before"))
        jump = F.abs(F.col("_after") - F.col("_before"))
        return (pair.where("_after IS NOT NULL AND _before IS NOT NULL").groupBy(*by, "_seam")
                .agg(F.avg(jump).alias("_jump")))

    means = seams("x", "y").unionByName(seams("y", "x")).groupBy(*by).agg(F.avg("_jump").alias("_score"))
    enough = (F.col("_w") >= 2 * block) & (F.col("_h") >= 2 * block)
    return size.join(means, by, "left").select(*by, F.when(enough, F.col("_score")).alias("score"))


# Limits of the seam classes.
SEAM_WARN, SEAM_BAD = 28.0, 38.0


def classify_seam(score: Column, ok: Column | None = None) -> Column:
    grade = (F.when(score.isNull(), F.lit("OK?")).when(score >= SEAM_BAD, F.lit("BAD"))
             .when(score >= SEAM_WARN, F.lit("WARN")).otherwise(F.lit("OK")))
    return grade if ok is None else F.when(~ok, F.lit("FAIL")).otherwise(grade)


def polygon_area(points: Column) -> Column:
    """Absolute shoelace area of an array of (x, y) structs."""
    n = F.size(points)

    def cross(acc: Column, i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, (i + 1) % n)
        return acc + (a.getField("x") * b.getField("y") - b.getField("x") * a.getField("y")).cast("double")

    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), cross)) / 2


def polygon_stats(polys: DataFrame, *, points: str = "points", width: str = "w", height: str = "h") -> DataFrame:
    """Clamped bounding box, ``degenerate`` flag, ``area`` and ``use_polygon`` (three points or more)."""
    def bound(kind, axis):
        return kind(F.transform(points, lambda p: p.getField(axis)))

    zero = F.lit(0)
    return polys.withColumns({
        "x1": F.greatest(zero, bound(F.array_min, "x")), "y1": F.greatest(zero, bound(F.array_min, "y")),
        "x2": F.least(F.col(width), bound(F.array_max, "x")), "y2": F.least(F.col(height), bound(F.array_max, "y")),
        "area": polygon_area(F.col(points)), "use_polygon": F.size(points) >= 3,
    }).withColumn("degenerate", (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")))


def largest_polygon(polys: DataFrame, *, by: str | Sequence[str], id: str, points: str = "points") -> DataFrame:
    """Polygon of the largest area per key (smallest id among equals)."""
    by = names(by)
    area = polygon_area(F.col(points))
    best = F.max_by(F.struct(id, "_area"), F.struct("_area", -F.col(id)))
    return (polys.withColumn("_area", area).groupBy(*by).agg(best.alias("_b"))
            .select(*by, F.col(f"_b.{id}").alias(id), F.col("_b._area").alias("area")))


def dominant_cluster(
    points: DataFrame, *, by: str | Sequence[str], point: str = "point", k: int = 3, steps: int = 3, digits: int = 6
) -> DataFrame:
    """Centre and size of the largest of ``k`` clusters per key (an image, say): key, ``cluster``, ``members``, ``centre``.

    The first centres are the key's ``k`` smallest distinct points; each of ``steps`` steps assigns every point to the nearest
    centre (the first of equally near ones) and moves the centres to the means, rounded to ``digits``.  A cluster that loses all
    its points goes.  Null points are ignored.
    """
    by = names(by)
    data = points.where(F.col(point).isNotNull()).select(*by, F.transform(point, lambda v: v.cast("double")).alias("_v"))
    # Only the k smallest points per key are held, also while they are gathered.
    first = number_rows(data.distinct(), by, ["_v"], "_c").where(F.col("_c") <= k)
    centres = first.select(*by, (F.col("_c") - 1).cast("int").alias("cluster"), F.col("_v").alias("centre"))
    for _ in range(steps):
        listed = centres.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("_centres"))
        apart = F.transform("_centres", lambda c: F.struct(_distance(F.col("_v"), c["centre"]).alias("d"), c["cluster"].alias("cluster")))
        placed = data.join(listed, by).select(*by, "_v", F.array_min(apart)["cluster"].alias("cluster"))
        means = placed.select(*by, "cluster", F.posexplode("_v").alias("_i", "_x")).groupBy(*by, "cluster", "_i").agg(
            F.round(F.avg("_x"), digits).alias("_x"), F.count(F.lit(1)).alias("members"))
        # One entry per dimension of the points.
        rows = F.sort_array(F.collect_list(F.struct("_i", "_x")))
        centres = means.groupBy(*by, "cluster").agg(F.max("members").alias("members"), F.transform(rows, lambda r: r["_x"]).alias("centre"))
    best = F.max_by(F.struct("cluster", "members", "centre"), F.struct("members", -F.col("cluster")))
    return centres.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def seeded_clusters(
    points: DataFrame, *, by: str | Sequence[str], point: str = "point", k: int = 3, tries: int = 3, steps: int = 20, eps: float = 1.0,
    seed: int = 0, digits: int = 6,
) -> DataFrame:
    """The largest of ``k`` clusters per key, from seeds spread by squared distance: key, ``cluster``, ``members``, ``centre``, ``spread``.

    Each of ``tries`` draws a first centre by chance and every further one with a chance in proportion to the squared distance
    from the centres before; then points go to the nearest centre (the first of equally near ones) and centres to the means, until
    no centre of the try moves by more than ``eps`` or ``steps`` are done.  The try with the least ``spread`` (squared distances from
    the centres) counts, its largest cluster is returned; ties go to the first.  Chances are hashes of ``seed``, so the result does
    not depend on how rows lie.  A key with fewer distinct points than ``k`` has as many clusters; null points are ignored.

    Equal points are one row with a count, combined before the shuffle, which keeps an image's many equal pixels together.
    All keys and tries move at once; only centres are kept between steps, and tries that have settled drop out.
    """
    by = names(by)
    given = points.where(F.col(point).isNotNull()).select(*by, F.transform(point, lambda v: v.cast("double")).alias("_v"))
    data = cut_lineage(given.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    width = data.agg(F.max(F.size("_v"))).first()[0] or 0
    none = F.array().cast("array<array<double>>")
    state = data.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try"), none.alias("_centres"))

    def apart(v: Column, centres: Column) -> Column:
        return F.array_min(F.transform(centres, lambda c: _distance(v, c)))

    for turn in range(k):
        chance = (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "_try", *by, "_v"), F.lit(1 << 31)) + 0.5) / float(1 << 31)
        far = F.lit(1.0) if turn == 0 else apart(F.col("_v"), F.col("_centres"))
        # The smallest of exponential waiting times is a draw in proportion to the weights.
        drawn = data.join(state, by).withColumn("_far", far).where("_far > 0").withColumn("_wait", -F.log(chance) / (F.col("_n") * F.col("_far")))
        next_ = drawn.groupBy(*by, "_try").agg(F.min(F.struct("_wait", "_v")).alias("_next"))
        grown = F.when(F.col("_next").isNull(), F.col("_centres")).otherwise(F.concat("_centres", F.array("_next._v")))
        state = cut_lineage(state.join(next_, [*by, "_try"], "left").select(*by, "_try", grown.alias("_centres")))

    def placed(centres: DataFrame) -> DataFrame:
        near = F.transform("_centres", lambda c, i: F.struct(_distance(F.col("_v"), c).alias("d"), i.cast("int").alias("cluster")))
        return data.join(centres, by).select(*by, "_try", "_centres", "_v", "_n", F.array_min(near).alias("_near"))

    settled, active = None, state
    for _ in range(steps):
        total = F.sum("_n")
        sums = [F.round(F.sum(F.get("_v", F.lit(i)) * F.col("_n")) / total, digits) for i in range(width)]
        means = placed(active).groupBy(*by, "_try", F.col("_near.cluster").alias("_c")).agg(F.filter(F.array(*sums), lambda x: x.isNotNull()).alias("_mean"))
        listed = means.groupBy(*by, "_try").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_mean"))).alias("_means"))
        # A centre without points stays where it is.
        new = F.transform("_centres", lambda c, i: F.coalesce(F.try_element_at("_means", i.cast("int")), c))
        stepped = active.join(listed, [*by, "_try"]).select(*by, "_try", "_centres", new.alias("_new"))
        moved = F.array_max(F.zip_with("_centres", "_new", _distance))
        stepped = cut_lineage(stepped.select(*by, "_try", F.col("_new").alias("_centres"), (moved > eps * eps).alias("_moves")))
        done = stepped.where("not _moves").drop("_moves")
        settled = done if settled is None else settled.unionByName(done)
        active = stepped.where("_moves").drop("_moves")
        if active.isEmpty():
            break
    final = active if settled is None else settled.unionByName(active)
    sized = placed(final).groupBy(*by, "_try", F.col("_near.cluster").alias("cluster")).agg(
        F.sum("_n").alias("members"), F.sum(F.col("_near.d") * F.col("_n")).alias("_d"), F.first("_centres").alias("_centres"))
    tried = sized.groupBy(*by, "_try").agg(
        F.round(F.sum("_d"), digits).alias("spread"), F.max(F.struct("members", (-F.col("cluster")).alias("minus"), "_centres")).alias("_b"))
    best = tried.groupBy(*by).agg(F.min(F.struct("spread", "_try", "_b")).alias("x"))
    cluster = -F.col("x._b.minus")
    return best.select(*by, cluster.alias("cluster"), F.col("x._b.members").alias("members"), F.get("x._b._centres", cluster).alias("centre"), F.col("x.spread").alias("spread"))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, d: total + d)
