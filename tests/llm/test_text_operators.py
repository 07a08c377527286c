"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import random

import pytest

import __spark_entry__  # noqa: F401  registers the package with the workers
from foliospark.llm import fm_index, lines, near_join, pii, toxicity
from foliospark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, n long, slot int"


def frame(spark, rows):
    """Documents with further columns, some with names that the operators use inside."""
    return spark.createDataFrame([(doc, text, "en", 1, 2) for doc, text in rows], SCHEMA)


def sentences(rng, n, words=60):
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(40)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = sentences(rng, 40)
    rows = list(enumerate(base))
    for i in range(30):  # one hot group of near copies, more than a short list holds
        words = base[0].split()
        words[rng.randrange(40)] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, base[1]) for i in range(25)]  # exact copies
    rows += [(300 + i, base[2] + "\n" + base[3 + i]) for i in range(8)]  # a shared passage
    rows += [(400, None), (401, ""), (402, " \n "), (403, "one two"), (404, "One  two"), (None, base[0]), (5, base[5]), (405, base[7] + " é " * 3000)]
    return rows


def test_near_groups(spark, corpus):
    got = near_join.near_groups(frame(spark, corpus)).collect()
    want = near_join.near_groups_brute(corpus)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_near_groups_empty(spark):
    assert near_join.near_groups(frame(spark, [])).collect() == []
    assert [tuple(r) for r in near_join.near_groups(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_near_groups_bridge(spark, monkeypatch):
    """Two families of one size joined by a pair whose two required tokens lie in a list of each family."""
    monkeypatch.setattr(near_join, "LEVELS", (2,))
    common = "c1 c2 c3 c4 c5 c6"
    rows = [(0, f"ua x1 w {common}"), (100, f"ub x2 w {common}")]
    rows += [(1 + i, f"ua x1 a{i} {common}") for i in range(20)] + [(101 + i, f"ub x2 b{i} {common}") for i in range(20)]
    rows += [(190, f"ua x1 x2 {common}"), (191, f"ub x1 x2 {common}")]
    rows += [(200 + i, "w " + " ".join(f"n{i}x{k}" for k in range(8))) for i in range(8)]
    got = near_join.near_groups(frame(spark, rows).coalesce(1), words=1).collect()
    want = near_join.near_groups_brute(rows, words=1)
    assert {label for doc, _, label in want if doc < 200} == {0}
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_groups_far_copies(spark, monkeypatch):
    """Copies with too many edits share frequent tokens with all of a family; only near misses may be paired with its members."""
    paired, candidates, verified = [], near_join._candidates, near_join._verified
    monkeypatch.setattr(near_join, "_candidates", lambda met, percent: (paired.append(met.count()), candidates(met, percent))[1])
    monkeypatch.setattr(near_join, "_verified", lambda pairs, *more: (paired.append(pairs.count()), verified(pairs, *more))[1])
    rng, rows = random.Random(11), []
    for doc in range(150):
        words = [f"w{i}" for i in range(100)]
        for at in rng.sample(range(100), rng.choice((2, 4, 22, 22)) if doc < 140 else rng.randint(8, 12)):
            words[at] = f"x{doc}x{at}"
        rows.append((doc, " ".join(words)))
    got = near_join.near_groups(frame(spark, rows).coalesce(1), words=1).collect()
    want = near_join.near_groups_brute(rows, words=1)
    assert len({label for _, _, label in want}) > 30
    assert sorted(map(tuple, got)) == sorted(want)
    # No step makes more rows than the first, which sets every member of the long lists beside one leader.
    assert max(paired) == paired[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}


@pytest.mark.parametrize("block", [10, 1000])
def test_components_of_blocks(spark, monkeypatch, block):
    """Edges of one block are joined without rounds, those of several in rounds over the blocks' forests."""
    from foliospark.llm import components as module

    rounds, small = [], module._small
    monkeypatch.setattr(module, "_small", lambda edges: (rounds.append(1), small(edges))[1])
    monkeypatch.setattr(module, "BLOCK", block)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (None, 3), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}
    assert bool(rounds) == (block == 10)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("limit", [lines.SMALL_FORMS, 1])
def test_drop_repeated(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "SMALL_FORMS", limit)
    rng = random.Random(2)
    base = sentences(rng, 14)
    rows = [(i, "\n".join(rng.choice(base) for _ in range(4)) + "\nshort line") for i in range(25)]
    for i in range(25):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] += "q"
        rows.append((50 + i, " ".join(words).upper() + " 12"))
    rows += [(90, None), (91, ""), (92, "a\n" * 3000), (None, rows[0][1]), (93, " ".join(["long"] * 4000))]
    got = lines.drop_repeated(frame(spark, rows)).select("doc_id", "text").collect()
    want = lines.drop_repeated_brute([r for r in rows if r[0] is not None]) + [r for r in rows if r[0] is None]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_drop_repeated_one_word(spark):
    """Near copies with one replaced word, whose SimHashes differ in many bits, against edit similarity alone."""
    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([4, 6, 7, 8]))) for _ in range(6 + i % 20)]
        rows.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
        rows.append((100 + i, " ".join(words)))
    got = {tuple(r) for r in lines.drop_repeated(frame(spark, rows)).select("doc_id", "text").collect()}
    want = set(lines.drop_repeated_brute(rows))
    assert sum(text == "" for _, text in want) >= 25
    assert got == want


def test_drop_repeated_digits(spark):
    """Lines that are equal but for their digits are compared with their digits."""
    rows = [(1, "12 34 56 78 90"), (2, "98 76 54 32 10"), (3, "Paris 12 450 33 9"), (4, "Paris 98 120 11 7"), (5, "12 34 56 78 91"), (6, "paris 12  450 33 9")]
    got = dict(map(tuple, lines.drop_repeated(frame(spark, rows)).select("doc_id", "text").collect()))
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: rows[3][1], 5: "", 6: ""}
    assert got == dict(lines.drop_repeated_brute(rows))


def test_drop_repeated_empty(spark):
    assert lines.drop_repeated(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [fm_index.BLOCK_CHARS, 40])
def test_contamination(spark, block):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([3, 9, 10, 14])))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, items[0][1]), (None, "q r s"), (53, "Ünder 9 é")]
    docs = [(i, " ".join(rng.choice("abcdE,.") for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, items[1][1].upper() + "; " + items[1][1]), (93, "x " * 4000 + "ünder 9 É; ünder 9 é"), (94, docs[0][1])]
    got = fm_index.mark_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_chars=block).collect()
    want = fm_index.contamination_brute(docs, items)
    for row in got:
        hit = {k for s in row.hit_spans for k in range(s.start, s.end)}
        assert (row.n_words, hit, set(row["items"])) == (want[row.doc_id][0], want[row.doc_id][1], want[row.doc_id][2] - {"None"})
        assert row.lang == "en" and row.slot == 2


def test_contamination_cut(spark):
    docs = frame(spark, [(1, "Keep this: alpha, beta gamma! And this\nline"), (2, None)])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: r.text for r in fm_index.mark_contamination(docs, items, cut=True).collect()}
    assert got == {1: "Keep this: ! And this\nline", 2: None}
    assert fm_index.mark_contamination(docs, items.limit(0)).select("items").distinct().collect()[0][0] == []


def test_toxicity(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["tree", "river", "stone", "house", "bird"]) for _ in range(30)) for _ in range(300)]
    toxic = [i % 4 == 0 for i in range(300)]
    rows = [(i, t + " vile scum" if bad else t) for i, (t, bad) in enumerate(zip(texts, toxic))] + [(900, None), (901, ""), (None, "vile scum"), (3, texts[3])]
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(toxic)] + [(500, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    known = [r for r in scored if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == toxic[r.doc_id] for r in known) >= 0.98 * len(known)
    assert {r.predicted for r in scored if r.doc_id in (900, 901)} == {0}
    none = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0))).collect()
    assert {r.predicted for r in none} == {0}


def test_toxicity_rows_are_packed():
    """A text of the sample is held in at most half of the eight bytes a bucket it took, and its values come back unchanged."""
    rng = random.Random(3)
    ratio = toxicity.np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    for text in [" ".join(f"w{rng.randrange(3000)}" for _ in range(600)), "a" * 70_000, "abc", "vile scum"]:
        found, counts = toxicity._counted(toxicity.grams(text))
        packed = toxicity._packed(found, counts)
        got, values = toxicity._unpacked(*packed, ratio)
        assert got.tolist() == found.tolist()
        assert values.tolist() == (ratio[found] * counts / toxicity.np.sqrt((counts * counts).sum())).astype("float32").tolist()
        if len(found) > 1000:
            assert sum(x.nbytes for x in packed) <= 4 * len(found)


def test_toxicity_held_out(spark):
    """Accuracy on the rows that were not trained on: 825, of which 97 are toxic."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where(toxicity.held_out()).join(labels, "doc_id").collect()
    bad = [r.score for r in rows if r.toxic == 1]
    good = [r.score for r in rows if r.toxic == 0]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.95
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(good)
    assert sum(r.predicted for r in rows if r.toxic == 1) >= 0.75 * len(bad)


def test_base_spans():
    text = "mail a.b@c-d.org, ip 10.0.0.255 and 1.2.3.256, card 4111 1111-1111 1111, tel +49 (30) 123-4567."
    assert [text[a:b] for _, a, b in pii.base_spans(text)] == ["a.b@c-d.org", "10.0.0.255", "4111 1111-1111 1111", "+49 (30) 123-4567"]
    assert pii.base_spans(None) == pii.base_spans("") == pii.base_spans("9" * 100_000) == []


def test_personal_data(spark):
    rows = [(i, f"call phone +1 (555) 555-{1000 + i} today") for i in range(12)]
    rows += [(50, "call phone 555 0123 today"), (51, "in the year 2019 of"), (52, None), (53, ""), (None, "mail x@y.de"), (50, "call phone 555 0123 today")]
    got = pii.personal_data(frame(spark, rows)).select("doc_id", pii.spelled("base").alias("base"), pii.spelled("spans").alias("spans")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.spans) for r in got if r.doc_id in (50, 51, 52, 53)} == {(50, "phone:11:19"), (51, ""), (52, ""), (53, "")}
    assert [r.base for r in got if r.doc_id is None] == ["email:5:11"]
    assert pii.personal_data(frame(spark, [])).collect() == []


def test_edit_distance():
    from foliospark.llm.lines import edit_distance

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abé字") for _ in range(rng.randrange(14))) for _ in range(2))
        assert edit_distance(a, b) == plain(a, b)
    long = "".join(rng.choice("abcdef ") for _ in range(500))
    edited = "".join(rng.choice(("", "x", c + "y")) if rng.random() < 0.1 else c for c in long)
    assert edit_distance(long, edited) == plain(long, edited)


def test_frequent_words_come_from_all_documents(spark):
    """A word of many lines counts as frequent wherever its documents lie; each of these lies outside a fiftieth by hash."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('common a', id, ' b', id, ' c', id, ' d', id) AS text")
    docs = docs.where("pmod(xxhash64(doc_id), 50) <> 0")
    common = lines._plain_words([b"common"])[1]
    assert lines._frequent(docs, 5).tolist() == common.tolist()


def test_near_pairs():
    """Bounds and distances of many pairs at once say the same as the distance of each pair."""
    rng = random.Random(5)
    for letters, low, high in (("abé字", 1, 14), ("ab", 60, 70), ("".join(map(chr, range(0x4E00, 0x9000))), 1, 150), ("abcdefgh ", 100, 300)):
        ta = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(150)]
        tb = ["".join(rng.choice(("", c, c, c, c, c + "a")) for c in a) or "x" for a in ta]
        ta, tb = ta + ["a" + "b" * 40, "xa", "a" * 30], tb + ["b" * 40, "a", "b" * 30]
        want = lines.np.array([lines.edit_distance(a, b) for a, b in zip(ta, tb)])
        assert (lines.edit_distances(ta, tb) == want).all()
        for edits in (want, want - 1, lines.np.array([max(len(a), len(b)) // 5 for a, b in zip(ta, tb)])):
            edits = lines.np.maximum(edits, 0)
            assert (lines._near(ta, tb, edits) == (want <= edits)).all()


def test_bundles_are_not_compared_again(spark):
    """What the lead of a key was compared with is no pair inside the bundle; a bundle of two has none."""
    from foliospark.llm.components import bundle_pairs, led_pairs

    members = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 0), (2, 21, 1), (2, 22, 1), (3, 30, 0), (3, 31, 9)], "key long, node long, size int")
    close = "abs(a.size - b.size) <= 1"
    found, bundles = led_pairs(members, close)
    assert {tuple(sorted(p)) for p in found.collect()} == {(10, 11), (20, 21), (20, 22)}
    none = spark.createDataFrame([], "node long, component long")
    assert {tuple(sorted(p)) for p in bundle_pairs(bundles, none, close).collect()} == {(21, 22)}


def test_brief_shuffles(spark):
    """Shuffle files of a step are gone when it has ended, and the setting is as before."""
    from pathlib import Path

    from foliospark.session import brief_shuffles, cut_lineage

    def files() -> set:
        root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return set(root.rglob("shuffle_*.data"))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, old = spark.conf.get(name), files()
    with brief_shuffles(spark):
        counts = cut_lineage(spark.range(1000).groupBy("id").count())
        assert not files() - old
    assert counts.count() == 1000 and spark.conf.get(name) == before


def test_lines_are_cut_in_small_parts():
    """A task holds a few times ``CHUNK`` characters, however long the batch is; it was over 30 bytes a character of two million."""
    import tracemalloc

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12_000)]
    batch = fm_index.pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    list(lines._counted(5)(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    found = list(lines._counted(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.column("lines")[-1].as_py() for b in found if b.column("word")[-1].as_py() is None) == len(texts)
    assert peak < 40e6


def test_stages_send_short_batches(spark):
    """A stage sends at most ``BATCH_ROWS`` whole texts at a time to a worker; fewer, if the session asks for that."""
    from foliospark.llm import stages

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for asked, least in (("10000", stages.BATCH_ROWS), ("0", stages.BATCH_ROWS), ("70", 70)):
            spark.conf.set(name, asked)
            stages.drop_repeated_lines(spark, frame(spark, []).selectExpr("*", "'' AS source"), "")
            sizes = spark.range(0, 3000, 1, 1).mapInArrow(lambda bs: (fm_index.pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
            assert max(r.n for r in sizes.collect()) == least
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("cell, blocks", [(256, 8), (4, 100), (4, 1)])
def test_lines_of_a_common_key(spark, monkeypatch, cell, blocks):
    """Texts move once for a line of a key and cell, not once for a pair, whether a key is one cell, some blocks, or more."""
    rng = random.Random(12)

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([5, 6, 7])))

    def line(start: str) -> str:
        return f"{start} {' '.join(word() for _ in range(3))}"

    kept = [line("gathering yesterday evening") for _ in range(40)]
    family = [line("something different altogether") for _ in range(2)]
    rows = list(enumerate(kept)) + [(100 + i, family[i % 2][:-1] + chr(97 + i)) for i in range(24)]
    rows += [(200, kept[7] + "x"), (201, family[0] + "!"), (202, None)]
    monkeypatch.setattr(lines, "CELL", cell)
    monkeypatch.setattr(lines, "BLOCKS", blocks)
    sent, dealt = [], lines.in_cells
    monkeypatch.setattr(lines, "in_cells", lambda rows: ("line" in rows.columns and sent.append(rows.count()), dealt(rows))[1])
    got = dict(map(tuple, lines.drop_repeated(frame(spark, rows)).select("doc_id", "text").collect()))
    assert got == dict(lines.drop_repeated_brute(rows))
    assert sum(text == "" for text in got.values()) >= 24
    pairs = 40 * 39 // 2
    assert sum(sent) < pairs / 2 if cell == 256 else sent


def test_line_dedup_leaves_no_files(spark):
    """What the steps store goes with them, so that a later stage finds the disk as it was."""
    from pathlib import Path

    from foliospark.session import checkpoint_folder

    def files() -> set:
        return set(Path(checkpoint_folder(spark).removeprefix("file:")).rglob("*.parquet"))

    before = files()
    rows = [(i, f"the same line of several words stands here\nand another one of number {i} {i * 7}") for i in range(20)]
    assert lines.drop_repeated(frame(spark, rows)).where("n_removed > 0").count() >= 19
    assert not files() - before
