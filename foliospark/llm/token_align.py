"""Alignment of two tokenizations of the same texts: shared ends, links between overlapping tokens, corpus-wide pair counts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import chunks
from foliospark.llm.pieces import MODEL
from foliospark.session import checkpoint_folder

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
# A block ends once it remembers this many windows, or holds this many links or documents: bounds of memory, not of results.
BLOCK_WINDOWS, BLOCK_LINKS, BLOCK_ROWS = 100_000, 2_000_000, 50_000
CHUNK_CHARS = 1 << 20
# Ids of both sides lie below 2^20: a pair of ids is one number, and B ids are told from A ids by the bit above.
_SHIFT, _OF_B = 20, 1 << 20

# Fixed value: how byte-level tokenizers of this family cut a text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens:
    """Bytes of every id of one vocabulary, with their lengths and whether they begin with a space."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        if len(spelled) > _OF_B:
            raise ValueError("vocabularies of more than 2^20 ids")
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.spaced = np.array([s[:1] == b" " for s in spelled])


class ByteLevel:
    """Tokenizer A: byte-level merges read from a tokenizers file.

    Where the file's ids rise with its merge order, byte ranks give the same ids (tests compare all code points) at a quarter of
    the time; other files are encoded by their own library.  What is read from the file is sent to the tasks, which build the encoder.
    """

    def __init__(self, text: str):
        found = json.loads(text)
        letters = _byte_letters()
        vocabulary, merges = found["model"]["vocab"], found["model"]["merges"]
        spelled = [b""] * (1 + max([*vocabulary.values(), *[t["id"] for t in found["added_tokens"]]]))
        for piece, k in vocabulary.items():
            spelled[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.tokens = Tokens(spelled)
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        split = found.get("pre_tokenizer") or {}
        usual = found.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = {t["content"] for t in found["added_tokens"]}
        ranked = usual and all(a < b for a, b in zip(made, made[1:]))
        self.ranks = {spelled[k]: k for piece, k in vocabulary.items() if piece not in added} if ranked else None
        self.text = None if ranked else text

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        if self.ranks is not None:
            import tiktoken

            one = tiktoken.Encoding("a", pat_str=BYTE_PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
            return lambda texts: [one(t) for t in texts]
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(self.text)
        library.encode_special_tokens = True
        return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a piece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled = []
        for k in range(library.get_piece_size()):
            piece = library.id_to_piece(k)
            spelled.append(bytes([int(piece[3:5], 16)]) if library.is_byte(k) else piece.replace("▁", " ").encode())
        self.tokens, self.model = Tokens(spelled), model

    def encoder(self) -> Callable[[list[str]], list[list[int]]]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return lambda texts: library.encode(texts, num_threads=1)


def signed_numerals(a: Tokens, b: Tokens) -> list[list[str]]:
    """A token's number with the sign behind it: "," inside a group, "|" behind its A tokens and ";" behind its B tokens."""
    numbers = range(max(len(a.spelled), len(b.spelled)))
    return [[f"{k}{sign}" for k in numbers] for sign in ",|;"]


class Block:
    """Windows already aligned, by their ids, and the documents made of them."""

    def __init__(self, a: Tokens, b: Tokens, numerals: list[list[str]]):
        self.a, self.b, self.numerals = a, b, numerals
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.links: list[bytes] = []
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = self.remembered = 0

    def add(self, a_list: list[int], b_list: list[int]) -> tuple[int, int, str, np.ndarray, np.ndarray]:
        """(groups, links, groups as text, distinct pairs, their links) of one document, put together from its windows."""
        a_ids, b_ids = np.array(a_list, np.int64), np.array(b_list, np.int64)
        a_end, b_end = np.cumsum(self.a.length[a_ids]), np.cumsum(self.b.length[b_ids])
        near = np.searchsorted(b_end, a_end)
        ends_both = b_end[near] == a_end
        after_a, after_b = np.flatnonzero(ends_both) + 1, near[ends_both] + 1
        anchor = np.append(self.a.spaced[a_ids[after_a[:-1]]] & self.b.spaced[b_ids[after_b[:-1]]], True)
        # Tokens by group, those of A first: a window's ids are one run of them.
        last_b = np.zeros(len(b_ids), np.int64)
        last_b[after_b - 1] = 1
        group_a, group_b = np.cumsum(ends_both) - ends_both, np.cumsum(last_b) - last_b
        marked, group = np.empty(len(a_ids) + len(b_ids), np.int32), np.empty(len(a_ids) + len(b_ids), np.int64)
        place_a, place_b = np.arange(len(a_ids)) + np.append(0, after_b)[group_a], np.arange(len(b_ids)) + after_a[group_b]
        marked[place_a], marked[place_b] = a_ids, b_ids + _OF_B
        group[place_a], group[place_b] = 2 * group_a, 2 * group_b + 1
        raw, stops = marked.tobytes(), (4 * (after_a[anchor] + after_b[anchor])).tolist()
        keys = [raw[i:j] for i, j in zip([0, *stops], stops)]
        known = self.known
        found = list(map(known.get, keys))
        if None in found:
            aligned = self._aligned(a_ids, b_ids, a_end, b_end, b_end[last_b == 0], group, marked, a_end[after_a[anchor] - 1])
            for w, (number, key) in enumerate(zip(found, keys)):
                if number is None:
                    found[w] = known[key] if key in known else self._learn(key, *aligned(w, stops))
        links = np.frombuffer(b"".join([self.links[k] for k in found]), np.int64)
        ordered = np.sort(links)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        pairs, times = ordered[first], np.diff(np.append(first, len(ordered)))
        return len(after_a), len(links), "".join([self.texts[k] for k in found])[:-1], pairs, times

    def _aligned(self, a_ids, b_ids, a_end, b_end, b_only, group, marked, anchors):
        """Text and links of the windows of one document.

        Between two neighbouring ends of either side lies one stretch of bytes inside one token of each: one link.
        """
        ends = np.sort(np.concatenate([a_end, b_only]))
        links = (a_ids[np.searchsorted(a_end, ends)] << _SHIFT) | b_ids[np.searchsorted(b_end, ends)]
        places = [0, *(np.searchsorted(ends, anchors) + 1).tolist()]
        last = np.append(group[1:] != group[:-1], True)
        signs = np.where(last, 1 + (group & 1), 0)
        numerals = self.numerals
        spelled = [numerals[sign][k] for sign, k in zip(signs.tolist(), (marked & (_OF_B - 1)).tolist())]

        def window(w: int, stops: list[int]) -> tuple[str, bytes]:
            first = stops[w - 1] // 4 if w else 0
            return "".join(spelled[first : stops[w] // 4]), links[places[w] : places[w + 1]].tobytes()

        return window

    def _learn(self, key: bytes, text: str, links: bytes) -> int:
        number = self.known[key] = len(self.texts)
        self.texts.append(text)
        self.links.append(links)
        self.remembered += len(links) // 8
        return number

    def keep(self, row: tuple, pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append(row)
        self.pairs.append(pairs)
        self.times.append(times)
        self.held += len(pairs)

    def full(self) -> bool:
        return len(self.texts) >= BLOCK_WINDOWS or self.held >= BLOCK_LINKS or self.remembered >= BLOCK_LINKS or len(self.rows) >= BLOCK_ROWS

    def numbered(self) -> tuple[list[tuple], list[dict]]:
        """(documents with their pairs as numbers, counts of the block's pairs in that order)."""
        every = np.concatenate(self.pairs) if self.pairs else np.empty(0, np.int64)
        pairs, places = np.unique(every, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        if len(every):
            np.add.at(counts, places, np.concatenate(self.times))
        ends = np.cumsum([len(p) for p in self.pairs]).tolist()
        places = places.astype(np.int32)
        rows = [(*row, places[i:j].tobytes(), times.astype(np.int32).tobytes()) for row, times, i, j in zip(self.rows, self.times, [0, *ends], ends)]
        return rows, [{"a": p >> _SHIFT, "b": p & (_OF_B - 1), "n": n} for p, n in zip(pairs.tolist(), counts.tolist())]


_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
_ENCODED = f"block long, {DIGEST}, at binary, times binary, pairs array<struct<a: int, b: int, n: long>>"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()] * 2 + [_PAIRS]
_NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "at", "times", "pairs"]


def _encoded(files, keep_groups: bool):
    """Documents with their digest and pairs, and behind the documents of a block one row with the counts of its pairs."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    def end(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        rows, pairs = block.numbered()
        for first in range(0, len(rows), 5000):
            yield batch([(number, *row, None) for row in rows[first : first + 5000]])
        yield batch([(number, *[None] * 9, pairs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = files.value
        a_encode, b_encode = a.encoder(), b.encoder()
        number = TaskContext.get().partitionId() << 32
        a_bytes, b_bytes = a.tokens.spelled, b.tokens.spelled
        none = np.empty(0, np.int64)
        numerals = signed_numerals(a.tokens, b.tokens)
        block = Block(a.tokens, b.tokens, numerals)
        for part, texts in chunks(batches, "text", CHUNK_CHARS):
            whole = [" " + t if t else "" for t in texts]
            for own, text, a_list, b_list in zip(part.column("doc_id").to_pylist(), whole, a_encode(whole), b_encode([t or "" for t in texts])):
                same = text and b"".join(map(a_bytes.__getitem__, a_list)) == b"".join(map(b_bytes.__getitem__, b_list)) == text.encode()
                if not same:
                    block.keep((own, 0, 0, 0, 0, "", "" if keep_groups else None), none, none)
                    continue
                groups, links, spelled, pairs, times = block.add(a_list, b_list)
                sha = hashlib.sha256(spelled.encode()).hexdigest()
                block.keep((own, len(a_list), len(b_list), groups, links, sha, spelled if keep_groups else None), pairs, times)
            if block.full():
                yield from end(number, block)
                number, block = number + 1, Block(a.tokens, b.tokens, numerals)
        if block.rows:
            yield from end(number, block)

    return run


def _summed(docs: pa.Table, scores: pa.Table) -> pa.Table:
    """n_best and count_sum of one block's documents from the corpus-wide counts of its pairs."""
    total, best = np.zeros(scores.num_rows, np.int64), np.zeros(scores.num_rows, np.int64)
    place = scores["place"].to_numpy()
    total[place], best[place] = scores["total"].to_numpy(), scores["best"].to_numpy()
    n_best, count_sum = [], []
    for at, times in zip(docs["at"].to_pylist(), docs["times"].to_pylist()):
        pairs, counts = np.frombuffer(at, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        n_best.append(int((counts * best[pairs]).sum()))
        count_sum.append(int((counts * total[pairs]).sum()))
    kept = docs.drop_columns(["block", "at", "times"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokens(docs: DataFrame, *, byte_bpe: str = BYTE_BPE, piece_model: str = MODEL, keep_groups: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum.

    A space and the text are encoded by the byte-level tokenizer (A), the text by the piece model (B), which adds that space.
    Where both end a token at the same byte, a group ends; ``groups`` spells them as ``a1,a2|b1;a3|b2,b3`` (null unless
    ``keep_groups``).  Tokens whose bytes overlap are linked; a pair of ids counts as often as it is linked in all documents.
    ``n_best`` are a document's links whose pair has the highest count of its B id, ties included; ``count_sum`` adds the
    counts of its links.

    Both tokenizations are whole.  Shared ends before tokens that begin with a space cut them into windows of ids; equal
    windows are aligned once per block and remembered by their ids.  A text that is null or empty, or that the tokens do not
    spell back exactly, has no tokens: zeros and ''.  Repeated rows count each; further columns are left out; no documents
    give no rows.

    Blocks of documents bound what a task remembers.  A block sends one row for each of its distinct pairs, so a frequent pair
    makes no more rows than there are blocks, and gets the corpus-wide counts back the same way; texts and tokens stay where
    they are.  The encoded table is written to the shared folder; the counts of B ids, bounded by the vocabulary, are broadcast.
    """
    spark = docs.sparkSession
    with open(byte_bpe, encoding="utf-8") as f, open(piece_model, "rb") as g:
        files = spark.sparkContext.broadcast((ByteLevel(f.read()), Pieces(g.read())))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = f"{checkpoint_folder(spark)}/aligned-{uuid.uuid4().hex}"
    slim.mapInArrow(_encoded(files, keep_groups), _ENCODED).write.parquet(path)
    encoded = spark.read.parquet(path)
    pairs = encoded.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "p")).select("block", "place", "p.a", "p.b", "p.n")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    counted = totals.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    scores = pairs.join(counted, ["a", "b"]).select("block", "place", "total", "best")
    rows = spark.read.parquet(path).where("pairs is null").drop("pairs")
    return rows.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(_summed, f"{DIGEST}, n_best long, count_sum long")


def align_brute(texts: list[str | None], byte_bpe: str = BYTE_BPE, piece_model: str = MODEL) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, from byte ranges and the tokenizers' own libraries."""
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_model)
    a.encode_special_tokens = True
    letters = _byte_letters()
    found, counts = [], Counter()
    for text in texts:
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a.id_to_token(k)) for k in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            found.append(([], [], [], []))
            continue
        spans = []
        for ids, parts in ((a_ids, a_bytes), (b_ids, b_bytes)):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append([(end - len(p), end, k) for end, p, k in zip(ends, parts, ids)])
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = [0, *sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})]
        groups = ["|".join(",".join(str(k) for s, e, k in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip(cuts, cuts[1:])]
        counts.update(links)
        found.append((a_ids, b_ids, groups, links))
    highest: dict[int, int] = {}
    for (_, k), n in counts.items():
        highest[k] = max(highest.get(k, 0), n)
    out = []
    for a_ids, b_ids, groups, links in found:
        best, total = sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a_ids), len(b_ids), len(groups), len(links), best, total, sha))
    return out
