"""Search, licences, pieces, pages, dialogues and the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from foliospark.llm import ball_tree, chat, html_text, licenses, pieces, queries
from foliospark.llm.pieces import Encoder, PieceIndex, Vocabulary

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="tokenizer file not present")


def test_top_inner_products(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(100)] + [(2000, None), (2001, []), (None, [1.0] * 6), (2002, [1.0, 2.0]), (7, rows[7][1])]
    vectors = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, vector array<double>, shard string, floor int")
    asked = vectors.where("vec_id % 50 = 0 or vec_id > 1999")
    got = ball_tree.top_inner_products(vectors, asked, k=5, shard_rows=64, block_rows=5).collect()
    want = set()
    good = [(i, v) for i, v in rows if i is not None and v]
    for q, v in {i: v for i, v in good if i % 50 == 0 or i > 1999}.items():
        best = sorted((-int(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert ball_tree.top_inner_products(vectors.limit(0), asked).collect() == []
    assert ball_tree.top_inner_products(vectors, asked.limit(0)).collect() == []


def test_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [None, 1.0]), (4, None), (5, [float("inf")]), (6, [])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", ball_tree.quantised("v")).collect()}
    assert got == {1: [128.0, -1.0], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_licenses(spark):
    texts = {
        1: "Prose first.\nLicensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.\nMIT", 3: "er kam mit dem Rad",
        4: None, 5: "", 6: "This work is licensed under the GNU General Public License, version 3.", 7: "the license of the driver", 8: "x " * 5000,
    }
    docs = spark.createDataFrame([(i, t, "en", 0.0) for i, t in [*texts.items(), (1, texts[1])]], "doc_id long, text string, family string, top double")
    model = licenses.fit_licenses(spark)
    got = licenses.scan_licenses(docs, model).where("confirmed").select("doc_id", "paragraph", "family").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "apache"), (1, 1, "apache"), (2, 0, "mit"), (6, 0, "gpl")]
    assert licenses.scan_licenses(docs.limit(0), model).collect() == []


@needs_model
def test_pieces_against_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    texts = ["Hello  world", "", " a ", "日本語 中", "\x00", "▁x", "   ", "a" * 700, "ab" * 400 + " " * 40, "x\ny\t", "😀 é ﬁ"]
    texts += ["".join(rng.choice("abcde  éñ\n日本") for _ in range(rng.randrange(60))) for _ in range(300)]
    ids, offsets = Encoder(Vocabulary.load(pieces.MODEL)).encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text)


@needs_model
def test_pieces_round_trip(spark):
    texts = ["Hello  world", "", None, " lead", "日本\n語", "e" * 5000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = pieces.decode_texts(pieces.encode_texts(docs)).collect()
    assert {r.doc_id: r.decoded for r in rows} == dict(enumerate(texts))
    assert pieces.encode_texts(docs.limit(0)).collect() == []


def test_unigram_paths():
    """Best paths of a small unigram vocabulary against all segmentations."""
    names = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab"]
    scores = np.array([0.0, -3.0, -3.1, -4.0, -4.2, -5.5, -2.0, -3.3, -4.4])
    v = Vocabulary(names, scores, np.array([False] + [True] * 8), np.full(256, -1), 0, False, True)

    def best(text):
        table = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            options = [(table[start][0] + scores[names.index(text[start:end])], table[start][1] + [names.index(text[start:end])]) for start in range(end) if text[start:end] in names[1:] and start in table]
            if options:
                table[end] = max(options)
        return table[len(text)]

    rng = random.Random(8)
    units = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    ids, first = PieceIndex(v, units).tokens()
    for i, unit in enumerate(units):
        own = ids[first[i] : first[i + 1]]
        assert "".join(names[k] for k in own) == unit and abs(scores[own].sum() - best(unit)[0]) < 1e-9


def test_html_whole_articles():
    tree = html_text.trained_tree()
    para = "The river rose in the night and the old bridge was closed to all carts by the morning, as the miller said."
    text = lambda page: html_text.main_text(page, tree)
    assert text(f"<body class='post no-sidebar'><p>{para}</p><p>{para}</p></body>") == f"{para}\n{para}"
    assert text(f"<article class='post comment-status-open'><h1 class='entry-header'>A flood</h1><p>{para}</p></article>") == f"A flood\n{para}"
    assert text(f"<div class='sidebar'><main><p>{para}</p></main></div>") == para
    assert text(f"<main><p>{para}</p></main><div class='comment-list'><article class='comment-body'><p>{para}</p></article></div>") == para
    assert text(f"<article><p>{para}</p><p>So it ended.</p><div><a href=x>More news here</a></div></article>") == f"{para}\nSo it ended."
    assert text("<article><p>With <math><mi>x</mi></math> above two.</p></article>") == "With x above two."
    for words in range(1, 60):
        for before in ((0, 0.0), (5, 1.0), (80, 0.0)):
            for after in (1, 2, 6, 30):
                assert tree.keep((words, 0.0, *before, after, 1.0, True, False, False, False))


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><a href='/'>Home</a></header><nav><ul><li><a href=x>A</a></ul></nav>"
        "<article><h1>Head &amp; line</h1><p>First  para\n graph of some words &lt;b&gt;<p>Second<br>one<!-- not --></article>"
        "<aside>Side words here</aside><div class='comments'><p>Reader says a lot of things about this and that</p></div><form><label>Name</label></form>"
        "<footer>&copy; me</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>" + "word " * 20000), (5, "u", "<<>><p"), (1, "u", page)]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, text string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == "Head & line\nFirst para graph of some words <b>\nSecond one"
    assert texts[2] == texts[3] == "" and len(texts[4]) == 99_999
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_perspectives(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "x"), (None, 0, None, "y"), (None, 1, "cy", "")]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "conv_id long, turn long, role string, text string, start string, _own int")
    for limit in (None, 1):
        got = sorted(map(tuple, chat.perspectives(frame, limit=limit).collect()), key=repr)
        assert len(got) == 4 * 2 + 2
        for conv, who in ((1, "ann"), (1, "bob"), (None, "cy")):
            own = sorted((r for r in got if r[0] == conv and r[1] == who), key=lambda r: r[5])
            whole = "".join(r[4] for r in own)
            assert [whole[r[5] : r[6]] for r in own] == [r[4] for r in own]
            assert all((r[7] is not None) == (r[3] == who) for r in own)
            assert all(whole[r[7] : r[8]].endswith(chat.END) for r in own if r[7] is not None)
    assert [r[4] for r in got if r[1] == "ann" and r[3] == "ann"] == ["<|start|>assistant\nhi <\\|end|><|end|>\n"]
    assert chat.perspectives(frame.limit(0)).collect() == []


def test_registered():
    names = set(entry_points.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.ORACLE) <= names


@needs_model
def test_pipeline(spark):
    """Every stage takes effect, keeps the columns of documents, and leaves clean documents alone."""
    import corpus_pipeline
    from foliospark.llm import lines, near_join

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, folder).cache()
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= {r.doc_id for r in before} and len(after) > 0.6 * len(before)
        rows = [(r.doc_id, r.text) for r in before]
        if name == "toxicity":
            # Comparing all lines in plain Python takes their square: the rest of the test goes on with short documents.
            short = [r for r in docs.collect() if len(r.text or "") < 700][:40]
            docs = spark.createDataFrame(short, docs.schema).cache()
        if name == "line_dedup":
            want = {d: t for d, t in lines.drop_repeated_brute(rows)}
            assert after == {d: want[d] for d in after} and all(not want[d].strip() for d in want if d not in after)
        if name == "ngram_jaccard_join":
            assert set(after) == {d for d, _, c in near_join.near_groups_brute(rows) if d == c}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.where("size(ids) <> n_tokens").count() == 0


@pytest.mark.parametrize("stage", ["line_dedup", "ngram_jaccard_join", "decontamination"])
def test_stages_of_odd_rows(spark, stage):
    """Nulls, empty texts, repeated ids, extra columns with clashing names, and no rows at all."""
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    rows = [(1, "one two three four five six seven", "en", "s", 3.0, 1, "x"), (1, "one two three four five six eight", None, None, None, None, None),
            (None, None, None, None, None, None, None), (2, "", "en", "s", 0.0, 2, "y"), (None, "a b", "en", "s", 1.0, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double, token int, row string")
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    got = run(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(got[0].asDict()) == ["doc_id", "lang", "n_chars", "source", "text"]
    assert {r.doc_id for r in got} == {1, 2, None} and len(got) >= 4 and {r.text for r in got if r.doc_id == 2} == {""}
    assert run(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []
