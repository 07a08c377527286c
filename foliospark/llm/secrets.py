"""Secret scans with built-in functions only: fixed patterns, and candidate strings by the entropy of a sliding window."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex")

# Characters of a window, and the entropy in bits that a window must reach by the class its characters come from.
WINDOW = 20
BASE64_BITS, HEX_BITS = 3.7, 3.0

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
HEX = "0123456789abcdefABCDEF"

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX_RUN = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
_HEX_PART = r"[0-9a-f]{%d,}|[0-9A-F]{%d,}"

# Strings that look random and are none: identifiers, words joined by signs, alphabets, placeholders.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^(?!.*[A-Za-z0-9]{11})",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"[Ee]xample|EXAMPLE|[Ss]ample|[Pp]laceholder|[Cc]hange_?me|[Dd]ummy|[Xx]{4}",
)
# What stands right before a checksum, a revision or the rest of an address.
ALLOWED_BEFORE = (
    r"""(?:[Ss][Hh][Aa]-?(?:1|224|256|384|512)|[Mm][Dd]5|[Cc]ommit|[Cc]hecksum|[Ii]ntegrity|[Ee][Tt]ag|[Dd]igest)["']?[ :=-]{0,3}["']?$""",
    r"https?://[^ \t\r\n]*$",
)
# Places of a list that are scanned together: copies made while a list grows stay in proportion to its length.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(lengths: Column) -> Column:
    """Sum of the lengths before each place of an array, and of all of them at the end: in blocks, so linear in the array."""

    def grown(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))

    def blocks(all_: Column) -> Column:
        count = F.ceil(F.size(all_) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        return let(cut, lambda parts: let(grown(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v)), F.lit(0)), lambda bases: joined(parts, bases)))

    def joined(parts: Column, bases: Column) -> Column:
        inner = F.transform(parts, lambda p, k: F.slice(grown(p, F.get(bases, k)), F.lit(1), F.size(p)))
        return F.concat(F.flatten(inner), F.slice(bases, F.lit(-1), F.lit(1)))

    return let(lengths, blocks)


def located(text: Column, pattern: str, found: Column | None = None) -> Column:
    """(start, end, value, before) of each match of ``pattern`` (without captures that split would return): places in code points.

    The text is split by the pattern; the lengths of what stands between matches, and of the matches, give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if found is None else found

    def placed(values: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.length(g) + F.length(v))
            return let(
                running_totals(steps),
                lambda ends: F.transform(
                    values,
                    lambda v, i: F.struct(
                        (F.get(ends, i + 1) - F.length(v)).alias("start"), F.get(ends, i + 1).alias("end"), v.alias("value"), F.get(gaps, i).alias("before")
                    ),
                ),
            )

        return F.when(F.size(values) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(F.array().cast(_MATCHES))

    return let(found, placed)


_MATCHES = "array<struct<start:int,end:int,value:string,before:string>>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _scale(n: int) -> int:
    """n log2 n in units of 2^-20 bits: whole numbers, so sums do not depend on their order."""
    return round(n * math.log2(n) * (1 << 20)) if n > 1 else 0


def _limit(bits: float, window: int) -> int:
    """The largest sum of :func:`_scale` over a window's counts that leaves it ``bits`` of entropy."""
    return math.floor(window * (math.log2(window) - bits) * (1 << 20))


def least_repetition(value: Column, alphabet: str, window: int) -> Column:
    """Least sum of n log2 n (in 2^-20 bits) over the character counts of all windows of a string; entropy is log2 of the window
    minus a window's share of it.  Counts are carried from window to window: one character comes in, one goes."""
    steps = F.array(*[F.lit(_scale(n + 1) - _scale(n)) for n in range(window + 1)])
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def put(counts: Column, k: Column, step: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), k), F.array(F.get(counts, k) + step), F.slice(counts, k + 2, F.lit(len(alphabet))))

    def state(counts: Column, total: Column, least: Column) -> Column:
        return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

    def folded(letters: Column) -> Column:
        def moved(acc: Column, i: Column) -> Column:
            come = F.get(letters, i)
            gone = F.when(i >= window, F.get(letters, i - window))
            counts = acc["counts"]
            entered = F.struct(put(counts, come, 1).alias("counts"), (acc["total"] + F.get(steps, F.get(counts, come))).alias("total"))
            shifted = F.when(gone.isNull(), entered).otherwise(
                let(entered, lambda e: F.struct(put(e["counts"], gone, -1).alias("counts"), (e["total"] - F.get(steps, F.get(e["counts"], gone) - 1)).alias("total")))
            )
            return let(shifted, lambda s: state(s["counts"], s["total"], F.when(i >= window - 1, F.least(acc["least"], s["total"])).otherwise(acc["least"])))

        start = state(F.array_repeat(F.lit(0), len(alphabet)), F.lit(0).cast("long"), F.lit(2**62).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, moved)["least"]

    return let(codes, folded)


def _last_before(spans: Column, place: Column) -> Column:
    """The last of sorted spans that starts before a place, or null: halving, so no span is compared with all others."""

    def halved(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        return F.when(acc["low"] >= acc["high"], acc).otherwise(
            let(
                middle,
                lambda m: F.when(F.get(spans, m)["start"] < place, F.struct((m + 1).alias("low"), acc["high"].alias("high"))).otherwise(
                    F.struct(acc["low"].alias("low"), m.alias("high"))
                ),
            )
        )

    bounds = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.get(spans, F.aggregate(F.sequence(F.lit(1), F.lit(31)), bounds, halved)["low"] - 1)


def _any(value: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(p)
    return found


def find_secrets(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    base64_bits: float = BASE64_BITS,
    hex_bits: float = HEX_BITS,
    allowed: Sequence[str] = ALLOWED,
    allowed_before: Sequence[str] = ALLOWED_BEFORE,
) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs`` (doc_id, text): spans are structs start, kind (place in KINDS), end.

    ``base`` are the matches of the fixed patterns, by start and kind; ``spans`` holds them and what the search adds.  Candidates
    are runs of ``window`` or more characters of the base64 alphabets.  A window slides over each; where its entropy reaches
    ``base64_bits`` the whole run is a span, else runs of hexadecimal digits inside it whose windows reach ``hex_bits`` are.  Runs
    that match an ``allowed`` pattern or follow an ``allowed_before`` one, hold a fixed pattern or overlap an assignment add none.

    Null text counts as empty and has no spans; repeated rows are returned each; positions are code points, end exclusive; further
    columns are left out.  All is computed inside the row with built-in functions: no shuffle, no Python worker.  Time is linear in
    the text, but for a logarithm where runs are held against assignments.
    """
    text = F.col("text")
    hex_part = _HEX_PART % (window, window)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def spans(matches: Column, kind: int) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    def assigned(values: Column) -> Column:
        long_enough = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        every = let(long_enough, lambda v: F.transform(located(text, ASSIGN, values), lambda m, i: F.struct(m["start"].alias("start"), F.lit(0).alias("kind"), m["end"].alias("end"), (F.length(F.get(v, i)) >= 8).alias("ok"))))
        kept = F.transform(F.filter(every, lambda m: m["ok"]), lambda m: m.dropFields("ok"))
        return F.when(F.size(values) > 0, kept).otherwise(F.array().cast(_SPANS))

    def added(candidates: Column, assigns: Column) -> Column:
        def suspicious(m: Column) -> Column:
            free = ~m["value"].rlike("[0-9a-f]{32}|AKIA[A-Z0-9]{12}") & ~_any(m["value"], allowed) & ~_any(m["before"], allowed_before)
            before = F.coalesce(_last_before(assigns, m["end"])["end"], F.lit(0))
            return F.when(free, before <= m["start"]).otherwise(F.lit(False))

        def judged(m: Column) -> Column:
            whole = least_repetition(m["value"], BASE64, window) <= _limit(base64_bits, window)
            parts = F.filter(located(m["value"], hex_part), lambda p: ~_any(p["value"], allowed) & (least_repetition(p["value"], HEX, window) <= _limit(hex_bits, window)))
            inner = F.transform(parts, lambda p: F.struct((m["start"] + p["start"]).alias("start"), F.lit(4).alias("kind"), (m["start"] + p["end"]).alias("end")))
            return F.when(whole, spans(F.array(m), 3)).otherwise(inner)

        return F.flatten(F.transform(F.filter(candidates, suspicious), judged))

    matched = slim.select(
        "doc_id",
        let(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), assigned).alias("_assign"),
        spans(located(text, ACCESS), 1).alias("_access"),
        spans(located(text, HEX_RUN), 2).alias("_hex"),
        located(text, _CANDIDATE % window).alias("_candidates"),
    )
    found = matched.select("doc_id", F.array_sort(F.concat("_assign", "_access", "_hex")).alias("base"), let(F.col("_assign"), lambda a: let(F.col("_candidates"), lambda c: added(c, a))).alias("_added"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "_added")).alias("spans"))


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def check_sql(window: int = WINDOW, base64_bits: float = BASE64_BITS, hex_bits: float = HEX_BITS) -> str:
    """The same in DuckDB SQL, each window counted anew.  Its patterns know no looking behind; its runs are as long as can be anyway."""

    def either(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    keys = "|".join(either(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    assign = "(" + keys + ")" + ASSIGN[ASSIGN.index(")") + 2 :]
    scales = ", ".join(str(_scale(n)) for n in range(window + 1))
    allowed = " OR ".join(f"regexp_matches(v, {quoted(p)})" for p in ALLOWED if "(?!" not in p)
    before = " OR ".join(f"regexp_matches(before, {quoted(p)})" for p in ALLOWED_BEFORE)
    peak = f"""list_min(list_transform(generate_series(1, length(v) - {window - 1}), lambda i: list_sum(list_transform(
              list_distinct(string_split(substr(v, i, {window}), '')), lambda ch: [{scales}][{window + 1} - length(replace(substr(v, i, {window}), ch, ''))]))))"""
    starts = """list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)"""
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p(kind, p) AS (VALUES (0, {quoted(assign)}), (1, 'AKIA[A-Z0-9]{{12,}}'), (2, '[0-9a-f]{{32,}}'), (9, '[A-Za-z0-9+/_=-]{{{window},}}')),
        m AS (SELECT doc_id, kind, regexp_extract_all(t, p) AS f, string_split_regex(t, p) AS g, CASE WHEN kind = 0 THEN regexp_extract_all(t, p, 2) END AS w FROM d, p),
        n AS (SELECT *, unnest(generate_series(1, len(f))) AS i FROM m WHERE len(f) > 0),
        x AS (SELECT doc_id, kind, f[i] AS v, g[i] AS before, w[i] AS w, {starts} AS start FROM n),
        b AS (SELECT doc_id, kind, start, start + length(v) AS stop FROM x WHERE kind IN (1, 2) OR kind = 0 AND length(w) >= 8),
        c AS (
          SELECT doc_id, start, v FROM x WHERE kind = 9 AND NOT regexp_matches(v, '[0-9a-f]{{32}}|AKIA[A-Z0-9]{{12}}') AND regexp_matches(v, '[A-Za-z0-9]{{11}}')
            AND NOT ({allowed}) AND NOT ({before})
            AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.kind = 0 AND b.start < x.start + length(x.v) AND b.stop > x.start)),
        e AS (SELECT *, {peak} <= {_limit(base64_bits, window)} AS whole FROM c),
        h AS (
          SELECT doc_id, base + {starts} AS start, f[i] AS v FROM (
            SELECT *, unnest(generate_series(1, len(f))) AS i FROM (
              SELECT doc_id, start AS base, regexp_extract_all(v, q) AS f, string_split_regex(v, q) AS g
              FROM (SELECT *, '{_HEX_PART % (window, window)}' AS q FROM e WHERE NOT whole)) WHERE len(f) > 0)),
        k AS (SELECT * FROM h WHERE regexp_matches(v, '[A-Za-z0-9]{{11}}') AND NOT ({allowed}) AND {peak} <= {_limit(hex_bits, window)}),
        s AS (
          SELECT * FROM b UNION ALL SELECT doc_id, 3, start, start + length(v) FROM e WHERE whole
          UNION ALL SELECT doc_id, 4, start, start + length(v) FROM k),
        o AS (
          SELECT doc_id, count_if(kind = 0) AS a, count_if(kind = 1) AS y, count_if(kind = 2) AS z,
            string_agg(line, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY start, kind) AS spans
          FROM (SELECT *, {list(KINDS)}[kind + 1] || ':' || start || ':' || stop AS line FROM s) GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(y, 0)::BIGINT AS n_access, coalesce(z, 0)::BIGINT AS n_hex,
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN o USING (doc_id)"""
