"""Exact Jaccard join of word shingles with adaptive multi-match prefixes, reduced to connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bitmap, chunks, in_bitmap, mix, shingles, slices, slot, sum_slices
from foliospark.llm.components import components
from foliospark.session import cut_lineage
from foliospark.skew import broadcast_if_small

# Counters of the frequency sketch, and the slices in which it is summed.
BUCKETS, SLICE = 1 << 20, 1 << 14
# Shingles counted together before those seen once are dropped, and the count from which a shingle is frequent.
COUNTED, FREQUENT = 1 << 22, 8
# Match requirements a document may choose from; cost of a verification for each shingle of the document in postings, and
# documents expected to share a shingle that is not frequent.
LEVELS, VERIFY_COST, RARE = (1, 2, 4, 8, 16, 32, 64, 128, 250), 0.4, 0.05
# Members of a list whose pairs are taken at once; longer lists are compared group by group.
SHORT_LIST = 16
# Ids (8 bytes each) up to which a counted table is sent to every task instead of moving texts or sets.
SMALL_ROWS = 200_000


def _profile(words: int):
    """Rows (doc_id, n, s1, s2) of every text, and packed (tokens, counts) of what a task sees more than once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1].astype(np.uint32)
        empty = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array([tokens.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch, texts in chunks(batches, "text"):
            sets = shingles(texts, words)
            n = len(texts)
            s1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            s2 = np.array([int(mix(s + np.uint64(1)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
            held += sets
            total += sum(map(len, sets))
            if total >= COUNTED:
                yield repeated(held)
                held, total = [], 0
        if total:
            yield repeated(held)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tokens, counts in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, np.int64)), pa.array(np.frombuffer(counts, np.uint32).astype(np.int64))], names=["token", "docs"])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS)
    for batch in batches:
        np.add.at(counts, batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("docs").to_numpy(zero_copy_only=False))
    found = slices(counts, SLICE)
    if found:
        yield found


def _sketch(profile: DataFrame) -> np.ndarray:
    """Document counts of frequent shingles by hash bucket, gathered from the whole corpus: 4 MB, whatever the corpus.

    A shingle counts as frequent if tasks have seen it ``FREQUENT`` times in batches in which it came more than once.  The
    counts only order the tokens and estimate costs, so what they miss costs time and never a link.
    """
    seen = profile.where("tokens is not null").select("tokens", "counts").mapInArrow(_unpacked, "token long, docs long")
    frequent = seen.groupBy("token").agg(F.sum("docs").alias("docs")).where(f"docs >= {FREQUENT}")
    largest = frequent.groupBy(F.expr(f"cast(shiftrightunsigned(token, {64 - BUCKETS.bit_length() + 1}) as int)").alias("bucket")).agg(F.max("docs").alias("docs"))
    return sum_slices(largest.mapInArrow(_bucketed, "slice int, at binary, values binary"), BUCKETS, SLICE).astype(np.float32)


def prefix(one: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, int, int]:
    """(prefix tokens in the common order, length of the single-match prefix, matches required, frequent tokens inside).

    The order is by estimated document frequency, then hash.  With l matches required the prefix holds n - needed + l
    tokens; l minimises the postings written and met plus the cost of verifying the candidates, of which there are at most
    postings met / l.
    """
    n = len(one)
    seen = counts[(one >> np.uint64(44)).astype(np.int64)]
    needed = -(-n * percent // 100)
    single = n - needed + 1
    levels = [level for level in LEVELS if level <= needed]
    wide = single + levels[-1] - 1
    if wide < n:
        limit = np.partition(seen, wide - 1)[wide - 1]
        inside = np.flatnonzero(seen <= limit)
    else:
        inside = np.arange(n)
    order = inside[np.argsort(seen[inside], kind="stable")][:wide]
    met = np.cumsum(seen[order] + RARE, dtype=np.float64)
    prices = [single + level + met[single + level - 2] * (1.0 + VERIFY_COST * n / level) for level in levels]
    matches = levels[int(np.argmin(prices))]
    head = order[: single + matches - 1]
    return one[head], single, matches, int((seen[head] > 0).sum())


def _postings(words: int, percent: int, sketch):
    """(token, doc, meta) for the prefix of every text.

    meta packs the set's size (31 bits) and four bytes: the share of frequent tokens, the token's place in the single-match
    prefix, the matches required and the token's level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch, texts in chunks(batches, "text"):
            tokens, docs, metas = [], [], []
            for doc, one in zip(batch.column("doc_id").to_pylist(), shingles(texts, words)):
                if len(one):
                    head, single, matches, frequent = prefix(one, counts, percent)
                    place = np.arange(len(head))
                    level = np.maximum(place - single + 2, 1)
                    tokens.append(head.view(np.int64))
                    docs.append(np.full(len(head), doc, np.int64))
                    metas.append((len(one) << 32) + (255 * frequent // len(one) << 24) + (np.minimum(255 * place // single, 255) << 16) + (matches << 8) + np.minimum(level, 255))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, docs, metas)], names=["token", "doc", "meta"])

    return run


def _sets(words: int, wanted):
    """(doc, packed set) of the documents that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = wanted.value
        for batch, texts in chunks(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(in_bitmap(filled, batch.column("slot").to_numpy(zero_copy_only=False)))
            if len(at):
                sets = shingles([texts[i] for i in at], words)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "packed"])

    return run


def _linked(percent: int):
    """(a, b) of the pairs whose sets are similar enough, by exact counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("pa"), batch.column("pb")
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link; either may be the leader of many, whose rows Spark can split in both joins."""
    pairs = cut_lineage(pairs)
    used = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    sets = sets.join(broadcast_if_small(used, SMALL_ROWS), "doc", "left_semi")
    left = sets.select(F.col("doc").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("doc").alias("b"), F.col("packed").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(_linked(percent), "a long, b long")


def _met(pairs: DataFrame, a: str, ma: str, b: str, mb: str) -> DataFrame:
    """One row per shared prefix token of a pair, with sizes, the matches required and the token's level on both sides.

    The smaller document comes first whatever its role in a list, so that a pair's tokens from several lists count together.
    """
    return pairs.select(
        F.least(a, b).alias("a"),
        F.greatest(a, b).alias("b"),
        F.shiftright(ma, 32).alias("na"),
        F.shiftright(mb, 32).alias("nb"),
        F.least(F.expr(f"({ma} >> 8) & 255"), F.expr(f"({mb} >> 8) & 255")).alias("required"),
        F.greatest(F.expr(f"{ma} & 255"), F.expr(f"{mb} & 255")).alias("level"),
    )


def _listed(lists: DataFrame) -> DataFrame:
    """Pairs of the members of short lists; a list's rows lie together behind the join, so no row moves."""
    members = lists.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc", "meta"))).alias("all")).select("all", F.posexplode("all").alias("at", "x"))
    pairs = members.select("x", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("y"))
    flat = pairs.select(F.col("x.doc").alias("a"), F.col("x.meta").alias("ma"), F.col("y.doc").alias("b"), F.col("y.meta").alias("mb"))
    return _met(flat.where("a <> b"), "a", "ma", "b", "mb")


def _counted(met: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity, with the tokens they share in the prefixes of the shorter requirement."""
    fit = met.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and level <= required")
    return fit.groupBy("a", "b", "required").agg(F.count(F.lit(1)).alias("met"))


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many tokens as the less demanding document asks for."""
    return _counted(met, percent).where("met >= required").select("a", "b").distinct()


def _short_candidates(met: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """The same for pairs met in short lists; what they may share in long lists besides is bounded by each one's tokens there."""
    inside = long.groupBy("doc").agg(F.count(F.lit(1)).alias("more"))
    pairs = _counted(met, percent)
    for side in "ab":
        own = inside.select(F.col("doc").alias(side), F.col("more").alias(f"more_{side}"))
        pairs = pairs.join(own, side, "left")
    enough = "met + least(coalesce(more_a, 0), coalesce(more_b, 0)) >= required"
    return pairs.where(enough).select("a", "b").distinct()


def _first_met(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups whose first common token, in the order of the prefixes, leaves enough tokens behind it.

    Similar sets share a token of both single-match prefixes, and all they share stands at or behind the first one.  So
    rows with a token further behind are not needed: the pair comes out of the list of its first token.
    """
    sides = [side.where("(meta & 255) = 1") for side in (left, right)]
    for k, (doc, own) in enumerate((("a", "na"), ("b", "nb"))):
        size = F.shiftright("meta", 32)
        single = size - F.ceil(size * percent / 100) + 1
        behind = size - F.floor(F.expr("(meta >> 16) & 255") * single / 255)
        sides[k] = sides[k].withColumn(own, size).withColumn(f"t{doc}", behind).withColumn(f"m{doc}", F.expr("(meta >> 8) & 255")).drop("meta")
    possible = "least(ia, ib) >= least(ma, mb)"
    enough = f"{100 + percent} * least(ta, tb) >= {percent} * (na + nb)"
    met = sides[0].join(sides[1], "token").where(f"ga <> gb and (gb = major or a < b) and {possible} and {enough}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# The leader of a list is the document with most frequent tokens for its size: of near copies the one with fewest changes.
_LEADER = "min(struct(255 - (shiftright(meta, 24) & 255) as rarity, doc, meta))"


def near_groups(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest
    doc_id that links reach.  Texts that are null or without words have no shingles and link with nothing.  Rows with a
    null doc_id are returned with a null component and link with nothing; rows that repeat a doc_id are one document
    whose texts all count.  Other columns are ignored.

    Equal sets are grouped by a 128-bit sum first.  For the rest, prefixes in the order of corpus-wide frequency meet in
    an inverted index.  A pair is verified if it shares as many prefix tokens as the less demanding of both documents asks for.
    Lists of at most ``SHORT_LIST`` documents give all their pairs, and what those may share in longer lists is bounded by each
    one's tokens there; other pairs have all their shared tokens in longer lists.  The longer lists' members are first compared with the one that has most frequent tokens; only members of different groups are
    paired after that, those outside the list's largest group with all, where the list's token can be the first they share and
    enough tokens are left behind it.  So a group of many near copies costs its size, not its square, and no pair of different
    groups that could link is skipped.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = cut_lineage(docs.mapInArrow(_profile(words), "doc_id long, n long, s1 long, s2 long, tokens binary, counts binary"))
    sketch = spark.sparkContext.broadcast(_sketch(profile))
    rows = profile.where("tokens is null").select("doc_id", "n", "s1", "s2")

    known = rows.where("n > 0 and doc_id is not null")
    same = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    copies = cut_lineage(known.join(same, ["n", "s1", "s2"]).select("doc_id", "first"))
    equal = copies.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    again = equal.select(F.col("a").alias("doc_id")).distinct()

    # Only the first of equal sets goes on; a repeated doc_id whose other text is no copy stays.
    alone = known.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("doc_id")
    again = again.join(alone, "doc_id", "left_anti")
    fresh = docs.where("doc_id is not null").join(broadcast_if_small(again, SMALL_ROWS), "doc_id", "left_anti")
    postings = fresh.mapInArrow(_postings(words, percent, sketch), "token long, doc long, meta long")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    lists = cut_lineage(postings.join(shared, "token"))
    long = lists.where(f"docs > {SHORT_LIST}").drop("docs")
    near = cut_lineage(_short_candidates(_listed(lists.where(f"docs <= {SHORT_LIST}")), long, percent))

    used = near.select("a").union(near.select("b")).union(long.select("doc")).withColumnRenamed("a", "doc")
    wanted = spark.sparkContext.broadcast(bitmap(used.select(slot("doc").alias("slot"))))
    sets = cut_lineage(fresh.withColumn("slot", slot("doc_id")).mapInArrow(_sets(words, wanted), "doc long, packed binary"))

    links = cut_lineage(equal.unionByName(_verified(near, sets, percent)))
    # Long lists: first every member with the list's leader, then members of other groups with the leader of the last group.
    lead = long.groupBy("token").agg(F.expr(_LEADER).alias("first"))
    lead = lead.select("token", F.col("first.doc").alias("lead"), F.col("first.meta").alias("lead_meta"))
    stars = _candidates(_met(long.join(lead, "token").where("doc <> lead"), "doc", "meta", "lead", "lead_meta"), percent)
    links = cut_lineage(links.unionByName(_verified(stars, sets, percent)))
    groups = components(links)
    placed = cut_lineage(_placed(long, groups))
    crossing = _crossing(placed)
    # A second leader for lists that hold several groups: the first document of the last group.
    stars = _candidates(_met(crossing.where("grp <> last_grp"), "doc", "meta", "lead", "lead_meta"), percent)
    more = _verified(stars, sets, percent)
    links = cut_lineage(links.unionByName(more))
    placed = cut_lineage(_placed(placed.drop("grp"), components(links)))

    # What is left: pairs of different groups that share a prefix token.
    sizes = placed.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("rows"))
    major = sizes.groupBy("token").agg(F.max_by("grp", F.struct("rows", "grp")).alias("major"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    # A document with fewer tokens in such lists than a pair requires cannot be part of it.
    held = placed.join(major, "token")
    tokens = held.groupBy("doc").agg(F.count(F.lit(1)).alias("inside"))
    mixed = cut_lineage(held.join(tokens, "doc"))
    left = mixed.where("grp <> major").select("token", F.col("doc").alias("a"), F.col("grp").alias("ga"), "meta", F.col("inside").alias("ia"))
    right = mixed.select("token", F.col("doc").alias("b"), F.col("grp").alias("gb"), "meta", F.col("inside").alias("ib"), "major")
    pairs = _first_met(left, right, percent)
    links = links.unionByName(_verified(pairs, sets, percent))
    groups = components(links)
    out = rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _placed(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings of the lists that hold more than one group, with the group of each document."""
    named = lists.select("token", "doc", "meta").join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "meta", F.coalesce("component", "doc").alias("grp"))
    several = named.groupBy("token").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("token")
    return named.join(several, "token", "left_semi")


def _crossing(placed: DataFrame) -> DataFrame:
    """The postings with the leader of the last group of their list."""
    last = placed.groupBy("token", "grp").agg(F.expr(_LEADER).alias("first"))
    lead = last.groupBy("token").agg(F.max_by("first", "grp").alias("first"), F.max("grp").alias("last_grp"))
    return placed.join(lead.select("token", "last_grp", F.col("first.doc").alias("lead"), F.col("first.meta").alias("lead_meta")), "token")


def near_groups_brute(rows: list[tuple], *, words: int = 5, percent: int = 80) -> list[tuple]:
    """The same result by comparing all pairs in plain Python; for tests."""
    import re

    def shingled(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()

    sets = [shingled(text) for _, text in rows]
    label = {doc: doc for doc, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, (x, _) in enumerate(rows):
            for j, (y, _) in enumerate(rows[:i]):
                if x is None or y is None or label[x] == label[y]:
                    continue
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    low = min(label[x], label[y])
                    label = {k: low if v in (label[x], label[y]) else v for k, v in label.items()}
                    changed = True
    return [(doc, len(s), label[doc]) for (doc, _), s in zip(rows, sets)]
