"""Personal data: fixed patterns for four kinds, and unseen identifiers found through the contexts of those."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Rounds of the pattern-instance scoring; instances of a kind that a pattern must have, and their share of all its instances.
ROUNDS, SUPPORT, CONFIDENCE = 2, 5, 0.7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: if the run's start fails, so do its later digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
# What may be an identifier: numbers with their usual separators, and words with a digit or an at sign.
_CANDIDATE = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]|\S*[@0-9]\S*")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_EDGES = "\"'`,;.!?()[]{}<>|*#%$&~^_"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, from at sign to at sign: linear in the text."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    if not text or not _ANY.search(text):
        return []
    out = [(0, *span) for span in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]


def _plain(word: str) -> str:
    return re.sub("[0-9]", "0", word.strip(_EDGES).lower())


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, both words before, and the words on both sides."""
    left = text[max(0, start - 60) : start].split()
    after = _WORD.search(text, end, end + 60)
    before = [_plain(w) for w in left[-2:]]
    if not before or not before[-1]:
        return []
    out = [f"1 {before[-1]}", f"3 {before[-1]} _ {_plain(after[0]) if after else ''}"]
    return out + ([f"2 {before[0]} {before[-1]}"] if len(before) == 2 and before[0] else [])


def found_in(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """(base spans, occurrences (kind or -1, start, end, instance, patterns)) of one text."""
    base = base_spans(text)
    if not text or not _ANY.search(text):
        return base, []
    seen = [(kind, start, end, text[start:end].lower()[:64], _contexts(text, start, end)) for kind, start, end in base]
    taken = sorted((start, end) for _, start, end in base)
    k = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGES and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        value = text[start:end]
        if any(a < end and start < b for a, b in taken[k : k + 4]) or len(value) > 64 or (sum(c.isdigit() for c in value) < 4 and "@" not in value):
            continue
        seen.append((-1, start, end, value.lower(), _contexts(text, start, end)))
    return base, seen


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SEEN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("inst", pa.string()), ("pats", pa.list_(pa.string()))]))
_SCHEMA = (
    "doc_id long, row long, base array<struct<kind: int, start: int, end: int>>, "
    "seen array<struct<kind: int, start: int, end: int, inst: string, pats: array<string>>>"
)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, seens = [], []
        for text in batch.column("text").to_pylist():
            base, seen = found_in(text)
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            seens.append([{"kind": k, "start": a, "end": b, "inst": i, "pats": p} for k, a, b, i, p in seen])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(bases, _SPAN), pa.array(seens, _SEEN)], names=["doc_id", "row", "base", "seen"])


def personal_data(docs: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs`` (doc_id, text): spans are structs kind (place in KINDS), start, end.

    ``base`` holds the matches of the fixed patterns, which seed the search; ``spans`` has them too, and what the search adds.
    Patterns are words around an identifier.  In every round the share of a pattern's distinct instances that are known to be
    of one kind is its confidence for the kind; with at least ``support`` of them and at least ``confidence`` it is accepted, and
    the instances it occurs with are scored by the combined confidence of their patterns.  Those at or above it become known.
    A later occurrence of a known instance in an accepted pattern of its kind is a new span.

    Null text counts as empty; repeated rows are returned each, with the same spans; positions are code points, end exclusive.
    Patterns and instances stay distributed tables; their counts are combined before the shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = cut_lineage(docs.withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(_extracted, _SCHEMA))
    seen = rows.select("row", F.explode("seen").alias("x")).select("row", "x.kind", "x.start", "x.end", "x.inst", F.explode("x.pats").alias("pat"))
    seen = cut_lineage(seen.distinct())
    edges = cut_lineage(seen.groupBy("pat", "inst").agg(F.max("kind").alias("kind")))
    totals = edges.groupBy("pat").agg(F.count(F.lit(1)).alias("all"))
    known = cut_lineage(edges.where("kind >= 0").select("inst", "kind").distinct())
    accepted = None
    for _ in range(rounds):
        hits = edges.drop("kind").join(known, "inst").groupBy("pat", "kind").agg(F.count(F.lit(1)).alias("hits")).where(f"hits >= {support}")
        sure = hits.join(totals, "pat").withColumn("sure", F.col("hits") / F.col("all")).where(f"sure >= {confidence}")
        accepted = cut_lineage(sure.select("pat", F.col("kind").alias("of"), "sure"))
        # Noisy-or over the patterns; a pattern without counterexamples still leaves a little doubt.
        doubt = F.exp(F.sum(F.log1p(-F.least("sure", F.lit(0.99)))))
        scored = edges.where("kind < 0").join(accepted, "pat").groupBy("inst", "of").agg((1 - doubt).alias("score"))
        best = scored.groupBy("inst").agg(F.max(F.struct("score", (-F.col("of")).alias("minus"))).alias("top")).where(F.col("top.score") >= confidence)
        known = cut_lineage(known.union(best.select("inst", (-F.col("top.minus")).cast("int"))).distinct())
    fresh = seen.where("kind < 0").drop("kind").join(accepted, "pat").join(known, "inst").where("of = kind")
    added = fresh.groupBy("row").agg(F.collect_set(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("added"))
    spans = F.array_sort(F.array_union("base", F.coalesce("added", F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)"))))
    return rows.join(added, "row", "left").select("doc_id", "base", spans.alias("spans"))


def spelled(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
