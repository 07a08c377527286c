"""Secrets, hard negatives and token alignment against brute force."""

import math
import os
import random
import re

import numpy as np
import pytest

from foliospark.llm import hard_negatives, pii, pieces, queries, secrets, token_align

needs_models = pytest.mark.skipif(not (os.path.exists(pieces.MODEL) and os.path.exists(token_align.BYTE_BPE)), reason="tokenizer files not present")


def plain_base(text):
    """The contract's patterns as they are stated: (start, kind, end)."""
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy(window):
    return -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


def added(text, base, window=secrets.WINDOW):
    out, last = [], 0
    for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % window, text):
        value, before, last = m[0], text[last : m.start()], m.end()
        held = re.search("[0-9a-f]{32}|AKIA[A-Z0-9]{12}", value) or any(k == 0 and a < m.end() and m.start() < b for a, k, b in base)
        if held or any(re.search(p, value) for p in secrets.ALLOWED) or any(re.search(p.replace("$", r"\Z"), before) for p in secrets.ALLOWED_BEFORE):
            continue
        best = lambda v: max(entropy(v[i : i + window]) for i in range(len(v) - window + 1))
        if best(value) >= secrets.BASE64_BITS:
            out.append((m.start(), 3, m.end()))
            continue
        for p in re.finditer("[0-9a-f]{%d,}|[0-9A-F]{%d,}" % (window, window), value):
            if not any(re.search(a, p[0]) for a in secrets.ALLOWED) and best(p[0]) >= secrets.HEX_BITS:
                out.append((m.start() + p.start(), 4, m.start() + p.end()))
    return out


def secret_texts():
    rng = random.Random(11)
    letters = secrets.BASE64
    make = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    parts = [
        lambda: "password = '" + make(rng.randrange(4, 14), letters) + "'", lambda: "Token:" + make(9, letters), lambda: "AKIA" + make(rng.randrange(8, 20), "ABCXYZ0123456789"),
        lambda: make(rng.randrange(28, 44), "0123456789abcdef"), lambda: make(rng.randrange(16, 40), letters), lambda: make(rng.randrange(18, 31), "0123456789ABCDEF"),
        lambda: "sha256: " + make(24, "0123456789ab"), lambda: "https://a.b/" + make(30, letters) + "?x=" + make(25, letters), lambda: "é😀 prose with words", lambda: "a1" * 15,
        lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "my_secret=" + make(12, letters) + "." + make(24, letters), lambda: "some-long/path-with/many_parts-2024",
        lambda: make(24, letters) + "secret: " + make(10, letters), lambda: "password=token: " + make(12, letters), lambda: "ſecret: longvalue123",
    ]
    return [" ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 8))) for _ in range(400)]


def test_secrets_against_brute_force(spark):
    texts = [*secret_texts(), "", None, "x" * 50000, "token=abcdefghij1234 " * 3000, "password password=", "q3x9Zk2LmP0wQ7rT5vY8 " * 400]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, spans int, _hex string")
    rows = {r.doc_id: r for r in secrets.find_secrets(docs.repartition(8)).collect()}
    assert len(rows) == len(texts) + 1
    kinds = set()
    for i, text in enumerate([*texts, texts[0]]):
        base = plain_base(text or "")
        assert [tuple(s) for s in rows[i].base] == base, text
        want = sorted(base + added(text or "", base))
        assert [tuple(s) for s in rows[i].spans] == want, text
        kinds |= {k for _, k, _ in want}
    assert kinds == {0, 1, 2, 3, 4}
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def test_secret_digest(spark, tmp_path):
    """The query's counts are by kind."""
    spark.createDataFrame([(1, "AKIA1234567890ABCD x AKIA1234567890ABCE"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_secret_scans(spark, str(tmp_path)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (0, 2, 0) and got[1].spans == "access:0:18,access:21:39" and got[2].spans == ""


def test_personal_digest(spark, tmp_path):
    text = "a@b.cc and c@d.ee, 10.0.0.1, 4111 1111 1111 1111, +49 30 1234567 +49 30 1234568"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_personal_data(spark, str(tmp_path)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 1, 1, 2) and (got[2].n_email, got[2].spans) == (0, "")
    assert pii.base_spans(text)[0] == (0, 0, 6)


def test_native(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    plan = secrets.find_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_negatives(rows):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v:
            good[i] = min(good.get(i, (label, v)), (label, v))
    out = set()
    score = lambda a, b: int(np.dot(good[a][1], good[b][1]))
    for a in good:
        if a % 50:
            continue
        others = [(-score(a, b), b) for b in good if b != a and len(good[b][1]) == len(good[a][1])]
        for minus, p in sorted(o for o in others if good[o[1]][0] == good[a][0])[:5]:
            fit = sorted(o for o in others if good[o[1]][0] != good[a][0] and 50 * -minus <= 100 * -o[0] <= 95 * -minus)[:3]
            out |= {(a, p, k + 1, n, -minus, -s) for k, (s, n) in enumerate(fit)}
    return out


def test_hard_negatives(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([1, 1, 2, 3]), [float(rng.randrange(-3, 12)) for _ in range(13)]) for i in range(900)]
    rows += [(1000 + i, 2, [2.0] * 13) for i in range(120)] + [(2000, None, [1.0] * 13), (2050, 1, None), (2100, 1, []), (None, 1, [1.0] * 13)]
    rows += [(2150, 1, [1.0, 2.0]), (2200, 2, [0.0] * 13), (2250, 4, [1.0] * 13), (7, rows[7][1], rows[7][2]), (50, 0, [5.0] * 13), (2300, 1, [-4.0] * 13)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, vector array<double>, block string, rank int")
    want = brute_negatives(rows)
    for shard, block in ((100_000, 100_000), (64, 7)):
        got = hard_negatives.hard_negatives(frame, frame.where("vec_id % 50 = 0"), shard_rows=shard, block_rows=block)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    assert hard_negatives.hard_negatives(frame.limit(0), frame.limit(0)).collect() == []


def test_summaries_bound_scores():
    rng = np.random.default_rng(3)
    rows = hard_negatives.Summaries(rng.integers(-200, 200, (200, 37)).astype(float))
    exact = rows.vectors @ rows.vectors[5]
    widths = []

    def keep(places, lower, upper):
        assert (lower <= exact[places]).all() and (exact[places] <= upper).all()
        widths.append((upper - lower).mean())
        return np.arange(len(places))

    places, scores = rows.refine(rows, 5, keep)
    assert len(places) == 200 and (scores == exact).all() and widths == sorted(widths, reverse=True) and len(widths) == 5


@needs_models
def test_token_alignment(spark, monkeypatch):
    rng = random.Random(13)
    texts = ["", None, "a▁b", "<|endoftext|> hello <s>", "日本語 中文字符 テスト", "  two  spaces ", "\n\n", "😀é ﬁ \x00 x", "e" * 3000, " " * 3000, "don't stop", "<0x41> " * 30]
    texts += [" ".join("".join(rng.choice("abeinrsté中.,1'") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60))) for _ in range(80)] + ["the end of the day"] * 40
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, block string, n_a int").repartition(5)
    want = token_align.align_brute(texts)
    for windows in (200_000, 50):
        monkeypatch.setattr(token_align, "BLOCK_WINDOWS", windows)
        monkeypatch.setattr(token_align, "CHUNK_CHARS", 2000)
        got = {r.doc_id: r for r in token_align.align_tokens(docs).collect()}
        for i, w in enumerate(want):
            r = got[i]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, texts[i]
    assert "|" in got[10].groups and token_align.align_tokens(docs.limit(0)).collect() == []


@needs_models
def test_byte_ranks_equal_library():
    """Ids of the byte-level tokenizer over every code point between letters, digits and signs, and over long runs."""
    from tokenizers import Tokenizer

    text = open(token_align.BYTE_BPE, encoding="utf-8").read()
    ours, library = token_align.ByteLevel(text), Tokenizer.from_str(text)
    library.encode_special_tokens = True
    assert ours.ranks is not None
    encode = ours.encoder()
    texts = [f"a{c}b 1{c}2 .{c}! {c} x {c}{c}y" for c in (chr(k) for k in range(0, 0x110000, 1) if not 0xD800 <= k < 0xE000 and (k < 0x3000 or k % 7 == 0))]
    texts += ["a" * 9000, " " * 9000, "ab" * 9000, "\n " * 5000]
    for first in range(0, len(texts), 20_000):
        part = texts[first : first + 20_000]
        assert encode(part) == [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_personal(text):
    """The contract's patterns as they are stated, by kind and start."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_base_against_brute_force():
    rng = random.Random(10)
    pieces_ = ["a.b@c.de", "x@y", "@z.q", "1.2.3.4", "300.1.1.1.9", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111-2", "+49 (30) 123-45.67", "+1", "é", " ", ".", "-", "@", "0", "+", "a%b+c@d-e.f-g.h"]
    found = set()
    for _ in range(20_000):
        text = "".join(rng.choice(pieces_) for _ in range(rng.randrange(1, 7)))
        want = plain_personal(text)
        assert pii.base_spans(text) == want, text
        found |= {k for k, _, _ in want}
    assert found == {0, 1, 2, 3} and pii.base_spans(None) == []
