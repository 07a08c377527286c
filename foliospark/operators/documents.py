"""Nested project documents: building, taking apart, updating, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.skew import GROUP_LIMIT, number_rows

BUBBLE_TYPE = ("struct<bubble_id:string,bbox:array<int>,raw_text:string,corrected_text:string,"
               "type:string,reading_order:bigint>")
PANEL_TYPE = f"struct<panel_id:string,image_path:string,bubbles:array<{BUBBLE_TYPE}>>"
DOCUMENT_SCHEMA = f"project string, part_no bigint, panels array<{PANEL_TYPE}>"
ROW_SCHEMA = f"project string, pos bigint, slice bigint, panel_id string, image_path string, bubbles array<{BUBBLE_TYPE}>"

# Most bubbles in one row of a document, and most rows of a project nested into a single value.
PART_SIZE = 10_000


def bubble_struct() -> Column:
    return F.struct(
        F.col("bubble_id").cast("string").alias("bubble_id"),
        F.array(*[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("corrected_text", F.lit("")).alias("corrected_text"),
        F.coalesce("type", F.lit("speech")).alias("type"),
        F.col("reading_order").cast("long").alias("reading_order"),
    )


def document_rows(panels: DataFrame, bubbles: DataFrame, *, slice_size: int = PART_SIZE, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Documents as rows ``project, pos, slice, panel_id, image_path, bubbles``: the key is (project, pos, slice) at every size.

    Bubbles (by order, then id) are nested in slices of at most ``slice_size``, counted from 0; a panel without bubbles is one
    row with [].  ``panels`` has one row per panel (``project, panel_id, image_path, pos``).
    """
    ordered = F.struct(F.coalesce("reading_order", F.lit(0)).cast("long").alias("_o"), "bubble_id")
    # Equal order and id: the values decide which slice a bubble falls into, as they do inside one.
    ranked = number_rows(bubbles.withColumn("_order", ordered), "panel_id", ["_order", bubble_struct()], "_nth", limit=limit)
    nested = (ranked.withColumn("slice", F.floor((F.col("_nth") - 1) / slice_size).cast("long")).groupBy("panel_id", "slice")
              .agg(F.sort_array(F.collect_list(F.struct("_order", bubble_struct().alias("b")))).alias("_sorted"))
              .select("panel_id", "slice", F.transform("_sorted", lambda s: s.getField("b")).alias("bubbles")))
    return panels.select("project", "panel_id", "image_path", F.col("pos").cast("long").alias("pos")).join(nested, "panel_id", "left").select(
        "project", "pos", F.coalesce("slice", F.lit(0).cast("long")).alias("slice"), F.col("panel_id").cast("string").alias("panel_id"),
        "image_path", F.coalesce("bubbles", F.array().cast(f"array<{BUBBLE_TYPE}>")).alias("bubbles"))


def nest_rows(rows: DataFrame, *, part_size: int = PART_SIZE, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """``project, part_no, panels``: document rows in their order, at most ``part_size`` in one value, parts counted from 0.

    A panel of several slices stands in the list once for each; nothing is dropped.
    """
    ranked = number_rows(rows, "project", ["pos", "slice"], "_nth", limit=limit)
    panel = F.struct("panel_id", "image_path", "bubbles")
    return (ranked.withColumn("part_no", F.floor((F.col("_nth") - 1) / part_size).cast("long")).groupBy("project", "part_no")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "slice", panel.alias("p")))).alias("_sorted"))
            .select("project", "part_no", F.transform("_sorted", lambda s: s.getField("p")).alias("panels")))


def build_documents(panels: DataFrame, bubbles: DataFrame, *, part_size: int = PART_SIZE) -> DataFrame:
    """Nest bubbles (by order) under panels (by ``pos``) under projects; panels without bubbles keep [].

    Both levels continue in further rows beyond ``part_size``: see :func:`document_rows` and :func:`nest_rows`.
    """
    return nest_rows(document_rows(panels, bubbles, slice_size=part_size), part_size=part_size)


def explode_panels(docs: DataFrame) -> DataFrame:
    """One row per panel, with its position in the document part."""
    return docs.select("project", "part_no", F.posexplode_outer("panels").alias("pos", "_p")).select(
        "project", "part_no", "pos", "_p.panel_id", "_p.image_path",
        F.coalesce("_p.bubbles", F.array().cast(f"array<{BUBBLE_TYPE}>")).alias("bubbles"))


def explode_bubbles(docs: DataFrame) -> DataFrame:
    """One row per bubble; panels without bubbles keep one row of nulls."""
    panels = explode_panels(docs).where("panel_id IS NOT NULL")
    rows = panels.select("project", "part_no", "panel_id", "image_path", F.posexplode_outer("bubbles").alias("pos", "_b"))
    box = [F.get("_b.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("project", "part_no", "panel_id", "image_path", "pos", "_b.bubble_id", *box, "_b.raw_text",
                       "_b.corrected_text", "_b.type", "_b.reading_order")


def upsert_panel(panels: DataFrame, updates: DataFrame, *, slice_size: int = PART_SIZE) -> tuple[DataFrame, DataFrame]:
    """(panels with matching ``bubbles`` replaced, updates whose panel is unknown).

    Both sides have ``project, panel_id, bubbles``; other panels stay untouched.  A panel is replaced as a whole: where it has
    several rows (``slice``, or ``part_no`` and ``pos``), the first takes the new bubbles and the others go; with ``slice`` the
    new bubbles are cut again into slices of at most ``slice_size``.  A panel updated more than once gets the update that
    is smallest by its values.
    """
    key = ["project", "panel_id"]
    new = updates.groupBy(*key).agg(F.min("bubbles").alias("_new"))
    merged = panels.join(new, key, "left")
    if "slice" in panels.columns:
        count = F.greatest(F.ceil(F.size("_new") / slice_size), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.cast("long").alias("slice"), F.slice("_new", i * slice_size + 1, F.lit(slice_size)).alias("bubbles")))
        kept = F.array(F.struct("slice", "bubbles"))
        merged = merged.where("_new is null or slice = 0").withColumn("_rows", F.when(F.col("_new").isNull(), kept).otherwise(cut))
        merged = merged.drop("slice", "bubbles").select("*", F.inline("_rows"))
    else:
        places = [c for c in ("part_no", "pos") if c in panels.columns]
        if places:
            first = panels.join(new.select(*key), key, "left_semi").groupBy(*key).agg(F.min(F.struct(*places)).alias("_first"))
            merged = merged.join(first, key, "left").where(F.col("_new").isNull() | (F.struct(*places) == F.col("_first")))
        merged = merged.withColumn("bubbles", F.coalesce("_new", "bubbles"))
    return merged.select(*panels.columns), updates.join(panels.select(*key), key, "left_anti")


def document_json(docs: DataFrame) -> DataFrame:
    """``project, part_no, json``: the document text, non-ASCII characters kept as they are."""
    return docs.select("project", "part_no", F.to_json(F.struct("project", "panels"), {"ignoreNullFields": "false"}).alias("json"))


def bubbles_to_json(bubbles: Column | str) -> Column:
    return F.to_json(bubbles, {"ignoreNullFields": "false"})


def parse_bubbles(text: Column | str) -> Column:
    """Bubble array from JSON text; inverted boxes are put right, missing texts and types get defaults."""
    raw = F.from_json(text, f"array<{BUBBLE_TYPE}>")

    def fixed(b: Column) -> Column:
        at = [F.get(b.getField("bbox"), F.lit(i)) for i in range(4)]
        box = F.array(F.least(at[0], at[2]), F.least(at[1], at[3]), F.greatest(at[0], at[2]), F.greatest(at[1], at[3]))
        return F.struct(
            b.getField("bubble_id").alias("bubble_id"), box.alias("bbox"),
            F.coalesce(b.getField("raw_text"), F.lit("")).alias("raw_text"),
            b.getField("corrected_text").alias("corrected_text"),
            F.coalesce(b.getField("type"), F.lit("speech")).alias("type"),
            b.getField("reading_order").alias("reading_order"))

    return F.transform(raw, fixed)
