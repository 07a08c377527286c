"""SentencePiece encoding and decoding, with every piece located through a suffix array of the batch's text."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# A piece has this mark at its start only, so no piece reaches from one unit into the next.
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Characters indexed at once, texts of one batch, units remembered by a task, and units merged one by one.
INDEX_CHARS, BATCH_CHARS, REMEMBERED, LONG_UNIT = 1 << 18, 1 << 20, 200_000, 256


# Rows that are decoded and handed back together.
ROWS = 512


@dataclass
class Vocabulary:
    """Pieces of a model: text and score by id, ids of the byte pieces, id of the unknown piece, and the kind of model."""

    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray
    bytes_: np.ndarray
    unknown: int
    merges: bool
    prefix: bool

    def __post_init__(self):
        ids = np.flatnonzero(self.usable)
        self.ids = ids
        self.longest = max(len(self.pieces[i]) for i in ids)
        # Equal scores share a rank: among them the leftmost pair is merged first.
        self.rank = np.zeros(len(self.pieces), np.int64)
        self.rank[ids] = np.unique(-self.scores[ids], return_inverse=True)[1]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece has a space mark behind other characters")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or kind not in (1, 2) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text as it is, of the unigram or merge kind, are supported")
        types = np.array([p.type for p in model.pieces])
        bytes_ = np.full(256, -1)
        for i in np.flatnonzero(types == 6):
            bytes_[int(model.pieces[i].piece[3:5], 16)] = i
        usable = np.isin(types, (1, 4))
        return cls([p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), usable, bytes_, int(np.flatnonzero(types == 2)[0]), kind == 2, norm.add_dummy_prefix)


class PieceIndex:
    """Edges (position, length, piece) of all occurrences of all pieces in a text whose units end in 0."""

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        self.v = vocabulary
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        self.starts = np.append(0, np.cumsum(sizes + 1))
        self.stops = self.starts[:-1] + sizes
        points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.points = points
        ends = self.starts[1:] - 1
        letters, codes = np.unique(points, return_inverse=True)
        codes = codes + 1
        codes[ends] = 0
        bits = int(len(letters)).bit_length()
        per, longest = 62 // bits, vocabulary.longest
        steps = -(-longest // per)
        padded = np.append(codes, np.zeros(per * steps, np.int64))
        packed = np.zeros(len(points) + per * (steps - 1), np.int64)
        for k in range(per):
            packed = (packed << bits) | padded[k : k + len(packed)]
        order = self._sorted(packed, len(points), per, steps)
        self.edges = self._edges(letters, packed, order, bits, per, steps)

    @staticmethod
    def _sorted(packed: np.ndarray, n: int, per: int, steps: int) -> np.ndarray:
        """Suffixes in the order of their first per * steps characters, which no piece exceeds."""
        order = np.argsort(packed[:n])
        key = packed[order]
        first = np.append(True, key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        for step in range(1, steps):
            if not len(tied):
                break
            at = order[tied]
            key, of = packed[at + per * step], group[tied]
            by = np.lexsort((key, of))
            order[tied], key = at[by], key[by]
            first = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
            group[tied] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
            tied = tied[~(first & np.append(first[1:], True))]
        return order

    def _edges(self, letters, packed, order, bits, per, steps) -> np.ndarray:
        """Piece by position and length, 0 where there is none: the edges sorted by position, one slot for each length."""
        v, n = self.v, len(order)
        text = "".join(v.pieces[i] for i in v.ids)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(v.pieces[i]) for i in v.ids])
        slot = np.searchsorted(letters, points)
        known = letters[np.minimum(slot, len(letters) - 1)] == points
        starts = np.append(0, np.cumsum(sizes)[:-1])
        present = np.logical_and.reduceat(known, starts)
        ids, sizes, starts = v.ids[present], sizes[present], starts[present]
        width = per * steps
        low = np.zeros((len(ids), width), np.int64)
        high = np.full((len(ids), width), (1 << bits) - 1, np.int64)
        for k in range(v.longest):
            has = sizes > k
            low[has, k] = high[has, k] = slot[starts[has] + k] + 1
        bounds = []
        for codes, after in ((low, False), (high, True)):
            keys = np.zeros((steps, len(ids)), np.int64)
            for k in range(width):
                keys[k // per] = (keys[k // per] << bits) | codes[:, k]
            a, b = np.zeros(len(ids), np.int64), np.full(len(ids), n, np.int64)
            while (a < b).any():
                middle = (a + b) >> 1
                at = order[np.minimum(middle, n - 1)]
                before, equal = np.zeros(len(ids), bool), np.ones(len(ids), bool)
                for step in range(steps):
                    here = packed[at + per * step]
                    before |= equal & (here < keys[step])
                    equal &= here == keys[step]
                if after:
                    before |= equal
                live = a < b
                a, b = np.where(live & before, middle + 1, a), np.where(live & ~before, middle, b)
            bounds.append(a)
        counts = np.maximum(bounds[1] - bounds[0], 0)
        at = order[np.repeat(bounds[0] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())]
        edges = np.zeros((n, v.longest + 1), np.int32)
        edges[at, np.repeat(sizes, counts)] = np.repeat(ids, counts)
        return edges

    def segment_starts(self) -> np.ndarray:
        """Where the tokens of all units begin, in ascending order."""
        return self._merged() if self.v.merges else self._best()

    def _merged(self) -> np.ndarray:
        """In every round each unit joins its neighbouring segments with the best-ranked joint piece, the leftmost of equals."""
        v, none = self.v, np.int64(1) << 40
        sizes = self.stops - self.starts[:-1]
        short = sizes <= LONG_UNIT
        inside = np.ones(len(self.points), bool)
        inside[self.stops] = False
        unit = np.repeat(np.arange(len(sizes)), sizes + 1)
        inside &= short[unit]
        at, unit = np.flatnonzero(inside), unit[inside]
        # stop[i]: end of the segment that begins at i; cost: rank of the piece it would form with the next segment.
        stop = np.arange(1, len(self.points) + 2)
        limit = self.stops[unit]

        def price(a, stop_of_unit):
            end = stop[stop[a]]
            ok = (stop[a] < stop_of_unit) & (end - a <= v.longest)
            piece = np.where(ok, self.edges[a, np.where(ok, end - a, 0)], 0)
            return np.where(piece > 0, v.rank[piece], none)

        cost = price(at, limit)
        done = [np.empty(0, np.int64)]
        while len(at):
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat((cost << 22) | np.arange(len(at)), heads)
            going = best >> 22 < none
            spans = np.diff(np.append(heads, len(at)))
            live = np.repeat(going, spans)
            done.append(at[~live])
            pick = (best & ((1 << 22) - 1))[going]
            gone = stop[at[pick]]
            stop[at[pick]] = stop[gone]
            cost[pick] = price(at[pick], limit[pick])
            left = pick[~np.isin(pick, heads, assume_unique=True)] - 1
            cost[left] = price(at[left], limit[left])
            live[pick + 1] = False
            at, unit, limit, cost = at[live], unit[live], limit[live], cost[live]
        for k in np.flatnonzero(~short).tolist():
            done.append(self._merged_long(int(self.starts[k]), int(self.stops[k])))
        return np.sort(np.concatenate(done))

    def _merged_long(self, start: int, stop: int) -> np.ndarray:
        """The same merges for one long unit, with a heap of the joinable neighbours."""
        v = self.v
        after, before = {i: i + 1 for i in range(start, stop)}, {i: i - 1 for i in range(start + 1, stop)}
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            middle = after.get(a, stop)
            if middle < stop:
                end = after[middle]
                piece = self.edges[a, end - a] if end - a <= v.longest else 0
                if piece:
                    heapq.heappush(heap, (int(v.rank[piece]), a, end))

        for i in range(start, stop):
            offer(i)
        while heap:
            _, a, end = heapq.heappop(heap)
            middle = after.get(a, stop)
            if middle >= stop or after[middle] != end:
                continue
            after[a] = end
            del after[middle]
            before.pop(middle, None)
            if end < stop:
                before[end] = a
            offer(a)
            if a in before:
                offer(before[a])
        return np.array(sorted(after), np.int64)

    def _best(self) -> np.ndarray:
        """Shortest paths: edges in the order of their position relax the score of their end; unknown characters cost extra."""
        v = self.v
        n = len(self.points)
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
        best[self.starts[:-1]] = 0.0
        worst = v.scores[v.ids].min() - 10.0
        sizes = self.stops - self.starts[:-1]
        for t in range(int(sizes.max(initial=0))):
            a = self.starts[:-1][sizes > t] + t
            for length in range(1, v.longest + 1):
                piece = self.edges[a, length]
                has = (piece > 0) | (length == 1)
                score = best[a[has]] + np.where(piece[has] > 0, v.scores[piece[has]], worst)
                end = a[has] + length
                better = score > best[end]
                best[end[better]], back[end[better]] = score[better], a[has][better]
        starts, at = [np.empty(0, np.int64)], self.stops[sizes > 0]
        base = self.starts[:-1][sizes > 0]
        while len(at):
            at = back[at]
            starts.append(at)
            at, base = at[at > base], base[at > base]
        return np.sort(np.concatenate(starts))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, first token of each unit); unknown characters become their bytes."""
        v, at = self.v, self.segment_starts()
        unit = np.searchsorted(self.starts, at, "right") - 1
        nexts = np.append(at[1:], self.starts[-1])
        size = np.minimum(nexts, self.stops[unit]) - at
        ids = self.edges[at, np.minimum(size, v.longest)].astype(np.int64)
        counts = np.ones(len(at), np.int64)
        lost = np.flatnonzero(ids == 0)
        spelled = {}
        for i in lost.tolist():
            raw = chr(self.points[at[i]]).encode("utf-8", "surrogatepass")
            spelled[i] = [int(v.bytes_[b]) for b in raw] if v.bytes_[0] >= 0 else [v.unknown]
            counts[i] = len(spelled[i])
        places = np.append(0, np.cumsum(counts))
        out = np.repeat(ids, counts)
        for i, own in spelled.items():
            out[places[i] : places[i + 1]] = own
        return out.astype(np.int32), places[np.searchsorted(at, self.starts)]


class Encoder:
    """Token ids of texts; remembers the units of the batches before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, units: list[str]) -> None:
        part: list[str] = []
        ids, first, size = [self.ids], [self.first], 0
        base = len(self.ids)
        for i, unit in enumerate(units):
            part.append(unit)
            size += len(unit) + 1
            if size >= INDEX_CHARS or i + 1 == len(units):
                own, places = PieceIndex(self.v, part).tokens()
                ids.append(own)
                first.append(places[1:] + base)
                base += len(own)
                part, size = [], 0
        self.ids, self.first = np.concatenate(ids), np.concatenate(first)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        if len(self.number) > REMEMBERED:
            self._forget()
        rows, fresh = [], []
        number = self.number
        for text in texts:
            marked = (SPACE if self.v.prefix and text else "") + (text or "").replace(" ", SPACE)
            row = []
            for unit in UNITS.findall(marked):
                k = number.get(unit)
                if k is None:
                    k = number[unit] = len(number)
                    fresh.append(unit)
                row.append(k)
            rows.append(np.array(row, np.int64))
        if fresh:
            self._learn(fresh)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        sizes = self.first[flat + 1] - self.first[flat] if len(flat) else flat
        ends = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(self.first[flat] - ends[:-1], sizes) + np.arange(ends[-1])] if len(flat) else self.ids[:0]
        return ids, ends[np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)]


def encode_texts(docs: DataFrame, *, model: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ids (array of int): the tokens of each whole text by the model file at ``model``.

    An empty text has no tokens and a null text has null.  Rows are independent; a column of docs that is called ``ids`` is
    replaced.  The vocabulary, whose size the model fixes, is read once and sent to the tasks.

    Units (a word with the blanks before it) are encoded once per batch: their joint text is indexed by a suffix array, each
    piece is searched in it, and the occurrences are the edges from which a segmentation is relaxed: the best path for
    unigram models, merges by rank for merge models, whose result is defined by that order and not by a path's score.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch, texts in chunks(batches, text, BATCH_CHARS):
            flat, offsets = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, kept.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode_texts(rows: DataFrame, *, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their token ids; null ids give null, ids outside the vocabulary are an error.

    Byte pieces are put together again; bytes that are no UTF-8 become U+FFFD.  The blank that encoding puts in front is
    taken off.  A column of rows that has the new name is replaced.
    """
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept = rows.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        spelled = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") if ok else b"" for p, ok in zip(v.pieces, v.usable)]
        spelled[v.unknown] = " ⁇ ".encode()
        for byte, i in enumerate(v.bytes_.tolist()):
            if i >= 0:
                spelled[i] = bytes([byte])
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            column, out = batch.column(ids), []
            values = column.values.to_numpy(zero_copy_only=False)  # of the whole batch, to which the offsets refer
            offsets = column.offsets.to_pylist()
            for i, null in enumerate(column.is_null().to_pylist()):
                if null:
                    out.append(None)
                    continue
                raw = b"".join([spelled[k] for k in values[offsets[i] : offsets[i + 1]].tolist()])
                out.append(raw[1 if v.prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return kept.mapInArrow(run, kept.withColumn(text, F.lit(None).cast("string")).schema)
