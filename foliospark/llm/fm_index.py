"""Benchmark passages in documents, found through an FM-index of each shard of training text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import encode

# Words are runs of 0-9, a-z (A-Z lower-cased) and everything above ASCII; all else becomes one space, byte for byte.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Words of one index; every SAMPLE-th suffix position is stored.
SHARD_WORDS, SAMPLE = 1 << 19, 8
# Characters of test phrases that are searched, and broadcast, at a time.
BLOCK_CHARS = 16_000_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence that ends in 0; every 0 counts as a symbol of its own behind all others.

    Prefix doubling that goes on sorting only suffixes still tied, so repeated passages cost the logarithm of their length.
    """
    n, top = len(symbols), int(symbols.max(initial=0))
    rank = np.where(symbols > 0, symbols, top + 1 + np.arange(n))
    order = np.argsort(rank, kind="stable").astype(np.int32)
    sorted_rank = rank[order]
    first = np.append(True, sorted_rank[1:] != sorted_rank[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)).astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = start
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    step = 1
    while len(tied):
        at = order[tied]
        key = place[at].astype(np.int64) * (n + 1) + place[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        first = np.append(True, key[1:] != key[:-1])
        place[at] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~(first & np.append(first[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over one shard; 0 stands for words that no phrase has and for document ends."""

    def __init__(self, symbols: np.ndarray):
        n, top = len(symbols), int(symbols.max(initial=0))
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.n = n
        # Suffixes that begin with a smaller symbol; 0 stands last and is never asked for.
        self.smaller = np.concatenate([[0, 0], np.cumsum(np.bincount(symbols, minlength=top + 1)[1:])]).astype(np.int64)
        # The walk to an earlier position may not pass a 0, so a position behind one is always stored.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.stored = np.append(0, np.cumsum(kept)).astype(np.int32)
        self.positions = order[kept]
        self.levels: list[tuple[np.ndarray, int]] = []
        row = before
        for bit in reversed(range(max(1, top.bit_length()))):
            zero = (row >> bit) & 1 == 0
            zeros = np.append(0, np.cumsum(zero)).astype(np.int32)
            self.levels.append((zeros, int(zeros[-1])))
            row = np.concatenate([row[zero], row[~zero]])
        self.bits = len(self.levels)
        self.origin = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))
        self.top = top

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (zeros, total) in enumerate(self.levels):
            below = zeros[at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1 == 0, below, total + at - below)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of the first ``at`` suffixes."""
        return self._descend(symbol, at) - self.origin[symbol]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the phrase, low, high) of the phrases (equally long rows) that occur."""
        which = np.flatnonzero((phrases <= self.top).all(axis=1))
        last = phrases[which, -1]
        low, high = self.smaller[last], self.smaller[last + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            live = low < high
            which, low, high = which[live], low[live], high[live]
            symbol = phrases[which, column]
            low, high = self.smaller[symbol] + self.rank(symbol, low), self.smaller[symbol] + self.rank(symbol, high)
        live = low < high
        return which[live], low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a stored position."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            here = self.stored[at + 1] > self.stored[at]
            out[open_[here]] = self.positions[self.stored[at[here]]] + steps
            open_, at = open_[~here], at[~here]
            symbol, low = np.zeros(len(at), np.int64), at
            for zeros, total in self.levels:
                below = zeros[low]
                one = zeros[low + 1] == below
                symbol = symbol * 2 + one
                low = np.where(one, total + low - below, below)
            at = self.smaller[symbol] + low - self.origin[symbol]
            steps += 1
        return out


def words_of(text: str | None) -> list[bytes]:
    return encode(text).translate(WORD_BYTES).split()


class Phrases:
    """Windows of the items as rows of word numbers, by length, with the items that hold each."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = defaultdict(set)
        for name, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(numbers) - width + 1)) if numbers else ():
                owners[tuple(numbers[i : i + width])].add(name)
        by_length: dict[int, list[tuple]] = defaultdict(list)
        for window in owners:
            by_length[len(window)].append(window)
        self.groups = [(k, np.array(rows, np.int64), [sorted(x for x in owners[r] if x is not None) for r in rows]) for k, rows in sorted(by_length.items())]


def _search(phrases: Phrases, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, list]]:
    """(length, positions, items) for every window that occurs."""
    index = FMIndex(symbols)
    for length, rows, owners in phrases.groups:
        which, low, high = index.ranges(rows)
        sizes = high - low
        spread = np.repeat(low - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        at = index.locate(spread)
        for row, part in zip(which.tolist(), np.split(at, np.cumsum(sizes)[:-1])):
            yield length, part, owners[row]


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the blanks behind them."""
    data = encode(text)
    found = list(re.finditer(rb"[^ ]+", data.translate(WORD_BYTES)))
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : found[start].start()])
        at = found[end - 1].end()
        while data[at : at + 1] in (b" ", b"\t"):
            at += 1
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)


def _marked(phrases):
    """Adds, for one block of phrases, the hit words and items of every text to the columns of the input."""

    def shard(batch: pa.RecordBatch, parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts])
        starts = np.append(0, np.cumsum(sizes + 1))
        symbols = np.zeros(starts[-1], np.int64)
        for at, part in zip(starts, parts):
            symbols[at : at + len(part)] = part
        cover = np.zeros(len(symbols) + 1, np.int64)
        named: list[set] = [set() for _ in parts]
        for length, at, owners in _search(phrases.value, symbols):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            for row in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                named[row].update(owners)
        hit = np.cumsum(cover[:-1]) > 0
        spans, items = [], []
        for row, (old, known) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist())):
            own = hit[starts[row] : starts[row] + sizes[row]].copy()
            for span in old:
                own[span["start"] : span["end"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            items.append(sorted(named[row] | set(known)))
        return _replaced(batch, {"n_words": pa.array(sizes, pa.int64()), "hit_spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = phrases.value.vocabulary.get
        for batch in batches:
            parts, first, total = [], 0, 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts.append(np.array([number(w, 0) for w in words_of(text)], np.int32))
                total += len(parts[-1])
                if total >= SHARD_WORDS:
                    yield shard(batch.slice(first, len(parts)), parts)
                    parts, first, total = [], i + 1, 0
            if parts:
                yield shard(batch.slice(first, len(parts)), parts)

    return run


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("hit_spans").to_pylist()):
            if spans:
                texts[i] = _cut(texts[i], [(s["start"], s["end"]) for s in spans])
        yield _replaced(batch, {"text": pa.array(texts, pa.string())})


def mark_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, block_chars: int = BLOCK_CHARS, cut: bool = False) -> DataFrame:
    """``docs`` (with a column text) plus n_words, hit_spans (merged word ranges, end exclusive) and items (sorted).

    A window is ``width`` successive words of an item of ``benchmark`` (item_id, text), or all words of a shorter one.
    Every row of docs is searched on its own, so repeated rows, ties and further columns are kept as they are; null text
    has no words.  Items without words take no part; an item without an id is searched but not named.  With ``cut`` the
    hit words and the blanks behind them are removed from text.

    Each task indexes its own shards, so no text is shuffled.  The phrases are searched in blocks of about
    ``block_chars`` characters (bounded, so that a block can be sent to every task); further blocks add to the spans.
    The new names replace columns of docs that have them already.
    """
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs.drop(*added.names).withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast(span), "items": F.array().cast("array<string>")})
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    for k in range(blocks):
        block = items.where(F.expr(f"pmod(xxhash64(text), {blocks}) = {k}"))
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()], width))
        out = out.mapInArrow(_marked(phrases), out.schema)
    return out.mapInArrow(_trimmed, out.schema) if cut else out


def contamination_brute(docs: list[tuple], items: list[tuple], width: int = 10) -> dict:
    """{doc_id: (n_words, set of hit words, set of items)} by trying every window at every place; for tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return pattern.findall("".join(c.lower() if c.isascii() else c for c in text or ""))

    out = {}
    for doc, text in docs:
        have, hit, names = split(text), set(), set()
        for name, phrase in items:
            want = split(phrase)
            for i in range(max(1, len(want) - width + 1)) if want else ():
                window = want[i : i + width]
                for at in range(len(have) - len(window) + 1):
                    if have[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        names.add(str(name))
        out[doc] = (len(have), hit, names)
    return out
