"""Nearest earlier and later mark of another owner for every probe of a line, found by one ordered walk each way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.session import stored

# Rows of whole keys that a task walks at once.
CHUNK_ROWS = 50_000
# Marks and probes of a slice, about.
SLICE_ROWS = 1_000_000
# What a row of a walked slice tells: a mark near enough, a probe that looks on beyond the slice, a mark seen from other slices.
HIT, OPEN, END = range(3)


def near_marks(events: DataFrame, reach: float, count: int) -> DataFrame:
    """``_n, _axis, _gap, _kind, _mark``: marks of another owner at most ``reach`` from a probe, the nearest among them.

    ``events`` (about ``count`` rows) holds marks and probes at ``_at`` on the line (``_page``, ``_axis``), set by ``_owner``;
    probes have the number ``_n`` and a ``_kind``, marks neither.  A mark without an owner is foreign to every probe.  The
    rows are dealt once, in the order of lines and positions, to slices that tasks walk; a line that crosses a border is
    taken up in the next slice by the two outermost marks of different owners of a slice, so no line has to fit into a task.
    """
    slices = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // SLICE_ROWS))
    order = ["_page", "_axis", "_at", "_n", "_owner"]
    kinds = {f.name: f for f in events.schema.fields}
    out = StructType().add("_what", "integer").add("_n", "long").add("_axis", "integer").add("_kind", "integer")
    out = out.add("_gap", kinds["_at"].dataType).add("_mark", kinds["_at"].dataType)
    out = out.add("_page", kinds["_page"].dataType).add("_owner", kinds["_owner"].dataType).add("_way", "integer").add("_slice", "integer")
    dealt = events.select("_page", "_axis", "_at", "_owner", "_n", "_kind").repartitionByRange(slices, *order).sortWithinPartitions(*order)
    # Range bounds are sampled per execution, so what the slices found is read from one materialised walk.
    walked = stored(dealt.mapInArrow(_slice_walk(reach), out))
    line = ["_page", "_axis", "_way"]
    state = StructType([out[c] for c in line]).add("_from", "integer").add("_to", "integer")
    for k in "12":
        state = state.add(f"_m{k}", out["_mark"].dataType).add(f"_o{k}", out["_owner"].dataType)
    # Four marks a slice at most.
    states = events.sparkSession.createDataFrame(_handed_on(walked.where(f"_what = {END}").collect()), state)
    late = walked.where(f"_what = {OPEN}").drop("_gap").withColumnRenamed("_mark", "_at")
    late = late.join(F.broadcast(states), line).where("_slice between _from and _to")
    mark = F.when(~F.col("_owner").eqNullSafe(F.col("_o1")), F.col("_m1")).when(~F.col("_owner").eqNullSafe(F.col("_o2")), F.col("_m2"))
    late = late.withColumn("_mark", mark).withColumn("_gap", F.abs(F.col("_mark") - F.col("_at"))).where(F.col("_gap") <= reach)
    found = ["_n", "_axis", "_gap", "_kind", "_mark"]
    return walked.where(f"_what = {HIT}").select(*found).unionByName(late.select(*found))


def _handed_on(ends: list) -> list[tuple]:
    """(line, way, first and last slice, two latest marks of different owners before these slices with their owners)."""
    lines: dict[tuple, dict[int, list]] = {}
    for e in ends:
        lines.setdefault((e["_page"], e["_axis"], e["_way"]), {}).setdefault(e["_slice"], []).append((e["_kind"], e["_mark"], e["_owner"]))
    out, none = [], (None, None)
    for line, found in lines.items():
        way, last, other = line[2], none, none
        places = sorted(found, reverse=way < 0)
        for place, after in zip(places, [*places[1:], places[-1] + way * 2**30]):
            newest, *rest = [(mark, owner) for _, mark, owner in sorted(found[place], key=lambda e: e[0])]
            # Until now the state was of an earlier slice; a slice with one owner keeps the last mark of another.
            other = rest[0] if rest else last if last != none and last[1] != newest[1] else other
            last = newest
            out.append((*line, min(place + way, after), max(place + way, after), *last, *other))
    return out


def _slice_walk(reach: float):
    """Marks near the probes of a slice, its probes that may find more beyond it, and its outermost marks."""

    def piece(rows: pa.Table, first: bool, last: bool) -> pa.Table:
        axis, kind = (rows.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("_axis", "_kind"))
        number, at = rows.column("_n").combine_chunks(), rows.column("_at").combine_chunks().to_numpy(zero_copy_only=False)
        probe = number.is_valid().to_numpy(zero_copy_only=False)
        number = number.fill_null(-1).to_numpy(zero_copy_only=False)
        line, owner = 2 * codes(rows.column("_page")) + axis, codes(rows.column("_owner"))
        probes, place = np.flatnonzero(probe), TaskContext.get().partitionId()
        near, parts = [], []

        def part(what, at_rows, way, nth=None):
            some = len(at_rows)
            kinds = kind[at_rows] if nth is None else nth
            return {"_what": np.full(some, what), "_n": number[at_rows], "_axis": axis[at_rows], "_kind": kinds, "_gap": np.zeros(some, at.dtype),
                    "_mark": at[at_rows], "_page": rows.column("_page").take(pa.array(at_rows)), "_owner": rows.column("_owner").take(pa.array(at_rows)),
                    "_way": np.full(some, way), "_slice": np.full(some, place)}

        for way, found, edge, open_ in zip((1, -1), walk_arrays(line, at, owner, probe), (0, -1), (first, last)):
            hit = found[probes]
            gap = np.abs(at[hit] - at[probes])
            ok = (hit >= 0) & (gap <= reach)
            near.append(np.stack([probes[ok], hit[ok]]))
            if open_:
                beyond = probes[(hit < 0) & (line[probes] == line[edge]) & (np.abs(at[probes] - at[edge]) <= reach)]
                parts.append(part(OPEN, beyond, way))
        near = np.concatenate(near, axis=1)
        gap, mark = np.abs(at[near[1]] - at[near[0]]), at[near[1]]
        best = np.lexsort((mark, kind[near[0]], gap, axis[near[0]], number[near[0]]))
        same = number[near[0][best]] * 2 + axis[near[0][best]]
        best = best[np.append(True, np.diff(same) != 0)[: len(best)]]
        hits = part(HIT, near[0][best], 0)
        hits |= {"_gap": gap[best], "_mark": mark[best], "_page": pa.nulls(len(best), rows.schema.field("_page").type),
                 "_owner": pa.nulls(len(best), rows.schema.field("_owner").type)}
        # The outermost mark and the next one of another owner: of the first line for the slices before, of the last for those behind.
        for way, edge, shown in ((-1, 0, first), (1, -1, last)):
            marks = np.flatnonzero(~probe & (line == line[edge]))[::-way]
            if shown and len(marks):
                ends = np.append(marks[:1], marks[owner[marks] != owner[marks[0]]][:1])
                parts.append(part(END, ends, way, np.arange(len(ends))))
        kinds = {"_what": pa.int32(), "_n": pa.int64(), "_axis": pa.int32(), "_kind": pa.int32(), "_way": pa.int32(), "_slice": pa.int32()}
        tables = [pa.table({c: pa.array(v, kinds.get(c)) if isinstance(v, np.ndarray) else v for c, v in p.items()}) for p in (hits, *parts)]
        return pa.concat_tables(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for table in key_chunks(batches, "_page"):
            if held is not None:
                yield from piece(held, first, False).to_batches()
                first = False
            held = table
        if held is not None:
            yield from piece(held, first, True).to_batches()

    return run


def key_chunks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold each key whole, from batches sorted by ``key``; a task holds a chunk and one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_ROWS or held[0].column(key)[0] == batch.column(key)[-1]:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks()
        last = keys[-1].as_py()
        tail = pc.sum(pc.is_null(keys) if last is None else pc.equal(keys, last)).as_py()
        yield table.slice(0, table.num_rows - tail)
        held = table.slice(table.num_rows - tail).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``work`` over tables that hold each key whole (:func:`key_chunks`)."""
    for table in key_chunks(batches, key):
        yield from work(table).to_batches()


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers from 0, nulls as -1."""
    found = column.combine_chunks().dictionary_encode().indices
    return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def walk_arrays(line: np.ndarray, at: np.ndarray, owner: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a walk each way finds: the rows of the marks below and above each row, -1 where there is none."""
    found = []
    for sign in (1, -1):
        order = np.lexsort((probe, sign * at, line))
        mark, who = ~probe[order], owner[order]
        place = np.arange(len(order))
        start = np.maximum.accumulate(np.where(np.append(True, np.diff(line[order]) != 0)[: len(order)], place, 0))
        last = np.maximum.accumulate(np.append(-1, np.where(mark, place, -1))[:-1])
        last[last < start] = -1
        turn = mark & (last >= 0) & (who[last] != who)
        # The mark before the latest change of owners, itself on this line.
        other = np.maximum.accumulate(np.append(-1, np.where(turn, last, -1))[:-1])
        other[other < start] = -1
        best = np.where((last >= 0) & (who[last] == who), other, last)
        rows = np.full(len(order), -1)
        rows[order] = np.where(best >= 0, order[best], -1)
        found.append(rows)
    return found[0], found[1]
