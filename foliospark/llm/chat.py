"""Multi-party dialogues, rendered once from the perspective of each participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.skew import GROUP_LIMIT, prefix_scan

START, END = "<|start|>", "<|end|>"
SYSTEM = "system"


def _escaped(column: Column) -> Column:
    """Text in which the marks of the format cannot occur."""
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def perspectives(turns: DataFrame, *, system: str = SYSTEM, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """One row per turn and participant of its dialogue: the segment of the dialogue rendered as that participant sees it.

    ``turns`` holds conv_id, turn, role, text; every role but ``system`` that speaks in a dialogue is a participant.  For each
    of them, its own turns are the assistant's, those of others are a user's with the role as name, and the system's stay.
    Columns: conv_id, perspective, turn, role, segment, start and stop (characters of the segment in the rendered dialogue,
    stop exclusive), mask_start and mask_stop (what is learnt: text and end mark of the participant's own turns, else null).
    The dialogue is the segments in the order of start.

    Turns stand in the order of turn (null first), ties by role and text; repeated rows are repeated turns.  A null conv_id is
    one dialogue of its own, a null role is a user without a name and no participant, a null text is empty.  A dialogue in which
    only the system speaks has no perspective.  Other columns are ignored.

    Dialogues are never gathered: offsets are running sums, split inside a dialogue of more than ``limit`` rows.
    """
    turns = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    people = turns.where(F.col("role").isNotNull() & (F.col("role") != system)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    seen = turns.join(people, turns.conv_id.eqNullSafe(people["_conv"])).drop("_conv")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    head = (
        F.when(own, F.lit(f"{START}assistant\n"))
        .when(F.col("role") == system, F.lit(f"{START}system\n"))
        .when(F.col("role").isNull(), F.lit(f"{START}user\n"))
        .otherwise(F.concat(F.lit(f"{START}user "), _escaped(F.col("role")), F.lit("\n")))
    )
    seen = seen.withColumns({"_own": own, "_head": F.length(head), "segment": F.concat(head, _escaped(F.col("text")), F.lit(f"{END}\n"))})
    size = F.length("segment").cast("long")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = prefix_scan(seen, ["conv_id", "perspective"], order, totals={"start": size}, limit=limit)
    stop = F.col("start") + size
    return placed.select(
        "conv_id", "perspective", "turn", "role", "segment", F.col("start").cast("long").alias("start"), stop.alias("stop"),
        F.when(F.col("_own"), F.col("start") + F.col("_head")).cast("long").alias("mask_start"),
        F.when(F.col("_own"), stop - 1).alias("mask_stop"),
    )
