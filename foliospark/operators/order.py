"""Reading order, numbering inside a source, and order editing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import row_overlap_sql
from foliospark.functions.names import panel_id
from foliospark.operators.suppress import FOLD_LIMIT, ranked_items
from foliospark.skew import (
    GROUP_LIMIT,
    as_columns,
    hot_keys,
    names,
    needed_limit,
    number_rows,
    prefix_scan,
    split_hot,
)

_POSITION = ("x1", "y1", "x2", "y2")


def cluster_rows(
    det: DataFrame,
    *,
    by: str | Sequence[str] = "page_id",
    rtl: bool = False,
    overlap: float = 0.4,
    tie: Sequence[str] = _POSITION,
    limit: int | None = FOLD_LIMIT,
) -> DataFrame:
    """Reading order of the boxes of a page: adds ``row_no`` and ``reading_order``.

    Boxes are taken by vertical centre; a box joins the first row whose first member it overlaps by
    more than ``overlap`` of the lower height, else it opens a row.  Rows read in opening order and
    left to right inside (right to left with ``rtl``).  ``tie`` orders boxes with equal centres.
    """
    by = names(by)
    hot = hot_keys(det, by, limit)
    if hot is None:
        return _row_fold(det, by, rtl, overlap, tie)
    from foliospark.operators.order_large import row_settle

    cold, warm = split_hot(det, by, hot)
    return _row_fold(cold, by, rtl, overlap, tie).unionByName(row_settle(warm, by, rtl, overlap, tie))


def rows_of_items(items: str, rtl: bool, overlap: float, payload: Sequence[str]) -> Column:
    """Array of (row_no, _side, _seq, payload…), in reading order, for an array of boxes in centre order.

    The state is the list of first members (``heads``) and the boxes placed so far (``out``).  A
    one-element array stands in for a local variable, so the search for a row runs once per box.
    """
    side = "-b.x1" if rtl else "b.x1"
    rest = ", ".join(f"'{c}', b.`{c}`" for c in payload)
    head = "named_struct('y1', b.y1, 'y2', b.y2)"

    def placed(row: str, seq: str) -> str:
        return f"named_struct('row_no', {row}, '_side', {side}, '_seq', {seq}, {rest})"

    found = f"array_position(transform(acc.heads, r -> {row_overlap_sql('r.', 'b.', overlap)}), true)"
    return F.expr(f"""aggregate(
        slice({items}, 2, size({items})),
        named_struct('heads', transform(slice({items}, 1, 1), b -> {head}),
                     'out', transform(slice({items}, 1, 1), b -> {placed('1L', '0')})),
        (acc, b) -> element_at(transform(array({found}), row -> named_struct(
            'heads', CASE WHEN row > 0 THEN acc.heads ELSE concat(acc.heads, array({head})) END,
            'out', concat(acc.out, array({placed('CASE WHEN row > 0 THEN row ELSE size(acc.heads) + 1L END', 'size(acc.out)')})))), 1),
        acc -> sort_array(acc.out))""")


def _row_fold(det, by, rtl, overlap, tie) -> DataFrame:
    payload = [c for c in det.columns if c not in by]
    centre = (F.col("y1") + F.col("y2")) / 2
    items = ranked_items(det, by, [centre, *tie])
    rows = rows_of_items("_items", rtl, overlap, payload)
    read = items.select(*by, F.posexplode_outer(rows).alias("_pos", "_box"))
    return read.select(*[F.col(c) if c in by else F.col(f"_box.{c}").alias(c) for c in det.columns],
                       F.col("_box.row_no").alias("row_no"), (F.col("_pos") + 1).cast("long").alias("reading_order"))


def sort_boxes(det: DataFrame, *, by: str | Sequence[str] = "page_id", limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Position of each box top to bottom, then left to right, as ``box_no``."""
    return number_rows(det, by, ["y1", "x1", "x2", "y2"], "box_no", limit=limit)


def top_score(det: DataFrame, *, by: str | Sequence[str] = "page_id", score: str = "score") -> DataFrame:
    """Best box per page, as a combinable aggregate."""
    by = names(by)
    rest = [c for c in det.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), *[-F.col(c) for c in _POSITION]))
    return det.groupBy(*by).agg(best.alias("_best")).select(*by, "_best.*").select(*det.columns)


def limit_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows of a listing."""
    return df.orderBy(*as_columns(order)).limit(n)


def number_pages(
    pages: DataFrame, *, source: str | Sequence[str] = "source_id", name: str = "name", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """1-based ``page_num`` by name inside a source."""
    return number_rows(pages, source, [name], "page_num", limit=limit)


def global_order(
    panels: DataFrame,
    pages: DataFrame,
    *,
    source: str | Sequence[str] = "source_id",
    page: str = "page_id",
    name: str = "name",
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Running panel number over a source: pages in order, panels by ``reading_order`` inside a page.

    The prefix sum runs over one count per page, not over panels, and pages without panels add nothing.
    """
    source = names(source)
    limit = needed_limit(pages, source, limit)
    counts = panels.groupBy(page).agg(F.count(F.lit(1)).alias("_panels"))
    counted = pages.select(*source, page, name).join(counts, page, "left")
    numbered = prefix_scan(counted, source, [name], rank="page_num",
                           totals={"_before": F.coalesce("_panels", F.lit(0))}, limit=limit)
    keep = [c for c in panels.columns if c not in source]
    return (panels.select(*keep).join(numbered.drop(name, "_panels"), page)
            .withColumn("global_order", F.col("_before") + F.col("reading_order")).drop("_before"))


def panel_ids(panels: DataFrame) -> DataFrame:
    """``panel_id`` from the reading order, and ``panel_num`` falling through to the global order."""
    return panels.withColumns({
        "panel_id": panel_id(F.col("reading_order")),
        "panel_num": F.coalesce(F.nullif(F.col("reading_order"), F.lit(0)), F.col("global_order")),
    })


def nth_free(
    wanted: DataFrame, taken: DataFrame, by: str | Sequence[str], *, nth: str, number: str, start: str,
    name: str, limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """The ``nth`` smallest integer from ``start`` on that is not in ``taken.number``, per key.

    A taken number with u - start - i + 1 free ones below it (i its rank) is skipped by every later
    request, so one merged prefix count answers all requests; no sequence is ever generated.
    """
    by = names(by)
    used = taken.where(F.col(number) >= F.col(start)).select(*by, start, number).distinct()
    used = number_rows(used, by, [number], "_i", limit=limit)
    used = used.select(*by, (F.col(number) - F.col(start) - F.col("_i") + 1).alias("_key"), F.lit(1).alias("_kind"),
                       F.col("_i").alias("_sub"))
    asked = wanted.withColumns({"_key": F.col(nth).cast("long"), "_kind": F.lit(0), "_sub": F.lit(0).cast("long")})
    merged = asked.unionByName(used, allowMissingColumns=True)
    scanned = prefix_scan(merged, by, ["_key", "_kind", "_sub"], totals={"_skip": F.col("_kind").cast("long")}, limit=limit)
    return (scanned.where("_kind = 0")
            .withColumn(name, F.col(start) + F.col(nth) - 1 + F.col("_skip"))
            .select(*wanted.columns, name))


def fill_orders(
    df: DataFrame, by: str | Sequence[str], *, pos: str = "pos", order: str = "reading_order", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """Give rows without a positive order the smallest unused integers, in list position."""
    by = names(by)
    limit = needed_limit(df, by, limit)
    has = F.coalesce(F.col(order) > 0, F.lit(False))
    one = df.withColumn("_one", F.lit(1).cast("long"))
    gaps = number_rows(one.where(~has), by, [pos], "_nth", limit=limit)
    filled = nth_free(gaps, one.where(has), by, nth="_nth", number=order, start="_one", name="_filled", limit=limit)
    filled = filled.withColumn(order, F.col("_filled").cast("long")).select(*df.columns)
    return df.where(has).withColumn(order, F.col(order).cast("long")).unionByName(filled)


def normalize_orders(
    df: DataFrame, by: str | Sequence[str], *, pos: str = "pos", order: str = "reading_order", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """Dense 1..n by the current order after filling; equal orders keep list position."""
    limit = needed_limit(df, by, limit)
    filled = fill_orders(df, by, pos=pos, order=order, limit=limit)
    dense = number_rows(filled, by, [order, pos], "_dense", limit=limit)
    return dense.withColumn(order, F.col("_dense")).select(*df.columns)


def assign_reading_order(
    bubbles: DataFrame,
    *,
    by: str | Sequence[str] = "panel_id",
    pos: str = "pos",
    rtl: bool = False,
    overlap: float = 0.4,
    limit: int | None = FOLD_LIMIT,
) -> DataFrame:
    """Keep the orders of a panel when every bubble has one, otherwise re-rank all of it by rows."""
    by = names(by)
    partial = bubbles.groupBy(*by).agg(F.max(F.col("reading_order").isNull().cast("int")).alias("_open"))
    flagged = bubbles.join(partial, by)
    cast = F.col("reading_order").cast("long")
    complete = flagged.where("_open = 0").withColumn("reading_order", cast).select(*bubbles.columns)
    open_ = flagged.where("_open = 1").drop("_open", "reading_order")
    ranked = cluster_rows(open_, by=by, rtl=rtl, overlap=overlap, tie=[pos], limit=limit)
    return complete.unionByName(ranked.select(*bubbles.columns))


def move_item(
    items: DataFrame,
    moves: DataFrame,
    by: str | Sequence[str],
    *,
    item: str = "item_id",
    pos: str = "pos",
    order: str = "reading_order",
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Apply at most one move per list: ``moves`` has the key, ``item`` and ``to`` (position) or ``delta``.

    A position is clamped to 1..n, a delta that leaves the list changes nothing, and so does a move
    to the present order; otherwise the items between shift by one and the list is renumbered.
    """
    by = names(by)
    limit = needed_limit(items, by, limit)
    kind = {"to": "long", "delta": "long"}
    cols = [F.col(c).cast(t).alias(f"_{c}") if c in moves.columns else F.lit(None).cast(t).alias(f"_{c}")
            for c, t in kind.items()]
    asked = moves.select(*by, F.col(item).alias("_item"), *cols)
    filled = number_rows(fill_orders(items, by, pos=pos, order=order, limit=limit), by, [order, pos], "_index", limit=limit)
    sizes = filled.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    target = (filled.join(asked, by).where(F.col(item) == F.col("_item")).join(sizes, by)
              .withColumn("_goal", F.coalesce(F.col("_to"), F.col("_index") + F.col("_delta")))
              .where(F.col("_to").isNotNull() | F.col("_goal").between(1, F.col("_n")))
              .select(*by, "_item", F.col(order).alias("_old"),
                      F.greatest(F.lit(1), F.least("_n", "_goal")).alias("_new"))
              .where("_old <> _new"))
    joined = filled.join(target, by, "left")
    here = F.col(order)
    shifted = (F.when(F.col(item) == F.col("_item"), F.col("_new"))
               .when((F.col("_old") < F.col("_new")) & (here > F.col("_old")) & (here <= F.col("_new")), here - 1)
               .when((F.col("_old") > F.col("_new")) & (here >= F.col("_new")) & (here < F.col("_old")), here + 1)
               .otherwise(here))
    moved = joined.withColumns({"_shift": shifted, "_hit": F.col("_new").isNotNull()})
    dense = number_rows(moved.where("_hit"), by, ["_shift", "_index"], "_dense", limit=limit)
    dense = dense.withColumn(order, F.col("_dense")).select(*items.columns)
    return moved.where("not _hit").select(*items.columns).unionByName(dense)


def neighbors(
    df: DataFrame, by: str | Sequence[str], *, item: str = "item_id", order: Sequence[str | Column] = ("pos",),
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """Previous and next item of each row, its 1-based ``index`` and the list ``total``."""
    by, order = names(by), as_columns(order)

    def windowed(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return part.withColumns({
            "prev_item": F.lag(item).over(w), "next_item": F.lead(item).over(w),
            "index": F.row_number().over(w).cast("long"),
            "total": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        })

    hot = hot_keys(df, by, limit)
    if hot is None:
        return windowed(df)
    cold, warm = split_hot(df, by, hot)
    ranked = number_rows(warm, by, order, "index", limit=limit)
    total = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    slim = ranked.select(*by, item, "index")
    prev = slim.select(*by, F.col(item).alias("prev_item"), (F.col("index") + 1).alias("index"))
    nxt = slim.select(*by, F.col(item).alias("next_item"), (F.col("index") - 1).alias("index"))
    linked = ranked.join(prev, [*by, "index"], "left").join(nxt, [*by, "index"], "left").join(total, by)
    return windowed(cold).unionByName(linked)


def stem_number(stem: Column) -> tuple[Column, Column]:
    """(root, n) of names such as root_2; n is null for other names."""
    pattern = r"^(.*)_([1-9][0-9]{0,17})$"
    n = F.expr("nullif(regexp_extract(_stem, '" + pattern + "', 2), '')").cast("long")
    return F.regexp_extract(stem, pattern, 1), F.when(n >= 2, n)


def unique_ids(
    df: DataFrame, by: str | Sequence[str], *, stem: str = "stem", pos: str = "pos", name: str = "panel_id",
    limit: int | None = GROUP_LIMIT,
) -> DataFrame:
    """First use of a stem keeps it, later ones take the first free ``stem_2``, ``stem_3``… in list order.

    A literal ``a_2`` competes with the second ``a``.  Going up the literal numbers k of a root, the
    literal is granted iff the repeats of the root seen before it fit into the free numbers below k;
    repeats then take the free numbers in order.  A refused literal behaves like a repeat of its own
    stem, so roots are resolved from the shortest name chain to the longest.
    """
    by = names(by)
    limit = needed_limit(df, by, limit)
    start = df.withColumn("_stem", F.coalesce(F.nullif(F.col(stem), F.lit("")), F.lit("panel")))
    work = number_rows(start, [*by, "_stem"], [pos], "_use", limit=limit)
    roots = work.where("_use = 2").select(*by, F.col("_stem").alias("_root")).distinct()
    root, n = stem_number(F.col("_stem"))
    literals = (work.where("_use = 1").withColumns({"_root": root, "_k": n}).where("_k is not null")
                .join(roots, [*by, "_root"], "left_semi"))
    # No literal meets a repeated root: the use count is the number.
    if literals.isEmpty():
        return work.withColumn(name, numbered(F.col("_use"))).select(*df.columns, name)
    from foliospark.operators.order_large import resolve_collisions

    return resolve_collisions(df, work, by, pos, name, limit)


def numbered(n: Column) -> Column:
    return F.when(n == 1, F.col("_stem")).otherwise(F.concat_ws("_", F.col("_stem"), n.cast("string")))


def next_bubble_id(
    bubbles: DataFrame, *, by: str = "panel_id", bubble: str = "bubble_id", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """Next free ``<panel>_b<n>`` per panel, n counted from the number of bubbles plus one."""
    limit = needed_limit(bubbles, by, limit)
    counts = bubbles.groupBy(by).agg((F.count(F.lit(1)) + 1).alias("_start"))
    taken = (bubble_numbers(bubbles, by, bubble).join(counts, by))
    wanted = counts.withColumn("_nth", F.lit(1))
    free = nth_free(wanted, taken, by, nth="_nth", number="_n", start="_start", name="_next", limit=limit)
    return free.select(by, F.concat(F.col(by).cast("string"), F.lit("_b"), F.col("_next").cast("string")).alias("next_id"))


def bubble_numbers(bubbles: DataFrame, by: str, bubble: str) -> DataFrame:
    """Numbers already used by ids of the form ``<panel>_b<n>``."""
    prefix = F.concat(F.col(by).cast("string"), F.lit("_b"))
    tail = F.expr(f"substring(`{bubble}`, length(concat(cast(`{by}` as string), '_b')) + 1)")
    return (bubbles.where(F.startswith(F.col(bubble), prefix) & tail.rlike("^[1-9][0-9]{0,17}$"))
            .select(by, F.expr("try_cast(" + f"substring(`{bubble}`, length(concat(cast(`{by}` as string), '_b')) + 1)"
                               + " as bigint)").alias("_n")).where("_n is not null"))
