"""The registered queries of this package: thin digests of the operators' results over the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.ball_tree import quantised, top_inner_products
from foliospark.llm.chat import perspectives
from foliospark.llm.common import table
from foliospark.llm.fm_index import mark_contamination
from foliospark.llm import secrets
from foliospark.llm.hard_negatives import hard_negatives
from foliospark.llm.html_text import extract_main_text
from foliospark.llm.licenses import fit_licenses, scan_licenses
from foliospark.llm.lines import drop_repeated
from foliospark.llm.near_join import near_groups
from foliospark.llm.pii import KINDS, personal_data, spelled
from foliospark.llm.pieces import MODEL, decode_texts, encode_texts
from foliospark.llm.token_align import align_tokens
from foliospark.llm.toxicity import fit_toxicity, held_out, score_toxicity


def _counts(spans: str, kinds: Sequence[str]) -> list[Column]:
    """Number of spans of each kind.  A lambda's second argument would be the place in the array, so the kind is no argument."""

    def number(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    return [number(k).alias(f"n_{name}") for k, name in enumerate(kinds)]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised("embedding").alias("vector"))
    return top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, fit_licenses(spark)).where("confirmed")
    families = found.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.count(F.lit(1)).alias("n_paragraphs"))
    joined = docs.select("doc_id").join(families, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The mark that stands for a blank is decoded as one, wherever it comes from.  Hashes spare the texts the way to the decoder.
    marked = docs.withColumn("sha", F.sha2(F.replace("text", F.lit("\u2581"), F.lit(" ")), 256))
    both = decode_texts(encode_texts(marked, model=model).drop("text"), model=model)
    same = F.col("sha").eqNullSafe(F.sha2("decoded", 256))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perspectives(table(spark, sf_dir, "conversations"))
    return rows.withColumn("segment_sha256", F.sha2("segment", 256)).drop("segment")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = _counts("base", KINDS)
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = _counts("base", secrets.KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(secrets.spelled("base"), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantised("embedding").alias("vector"))
    return hard_negatives(vectors, vectors.where("vec_id % 50 = 0"), positives=5, negatives=3, low=50, high=95)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op13_token_alignment": op13_token_alignment,
    "op11_secret_scans": op11_secret_scans,
    "op12_hard_negatives": op12_hard_negatives,
    "op3_license_scans": op3_license_scans,
    "op10_personal_data": op10_personal_data,
    "op8_html_extraction": op8_html_extraction,
    "op1_exact_top_k": op1_exact_top_k,
    "op9_chat_formatting": op9_chat_formatting,
    "op2_line_dedup": op2_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
}

ORACLE: dict[str, str] = {
    "op11_secret_scans": secrets.check_sql(),
    "op1_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
        p AS (SELECT a, c AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
        n AS (
          SELECT p.a AS anchor_id, p.p AS positive_id, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c)::INTEGER AS rank
          FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op5_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
          FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a)
        SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c.r) AS component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY w.doc_id""",
    "op7_benchmark_decontamination": """
        WITH b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        i AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + 9], ' ') AS s
          FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
        d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        g AS (
          SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
        m AS (SELECT doc_id, item_id, p, g.k FROM g JOIN i ON g.s = i.s AND g.k = i.k),
        h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_chat_formatting": """
        WITH p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
        t AS (
          SELECT c.conv_id, perspective, turn, role, text, role IS NOT DISTINCT FROM perspective AS own,
            CASE WHEN role = perspective THEN '<|start|>assistant' || chr(10) WHEN role = 'system' THEN '<|start|>system' || chr(10)
              WHEN role IS NULL THEN '<|start|>user' || chr(10)
              ELSE '<|start|>user ' || replace(role, '<|', '<\\|') || chr(10) END AS head,
            replace(coalesce(text, ''), '<|', '<\\|') || '<|end|>' || chr(10) AS body
          FROM conversations c JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id),
        s AS (
          SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t)
        SELECT conv_id, perspective, turn, role, start, start + length(head || body) AS stop,
          CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(head || body) - 1 END AS mask_stop,
          sha256(head || body) AS segment_sha256
        FROM s""",
}
