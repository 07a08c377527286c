"""Text lines, engine fallback and repair of misread names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.skew import in_parts, names

# The characters a text strip removes (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINES_PER_PART = 1_000_000


def strip(text: Column | str) -> Column:
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITESPACE))


def merge_text_lines(
    lines: DataFrame, *, by: str | Sequence[str] = "doc_id", sep: str = "\n", simple: bool = False,
    part_size: int = LINES_PER_PART,
) -> DataFrame:
    """Recognised lines (``pos, y, text``) to one text per key.

    Trimmed, blank lines dropped, top to bottom (equal ``y`` in list order), joined by ``sep``.
    ``simple`` joins in list order with a space instead.  Always one row per key: the lines of a key beyond
    ``part_size`` are joined in parts first, and the parts then.
    """
    by = names(by)
    raw = lines.where(F.length("text") > 0)
    clean = raw.withColumn("text", strip("text"))
    if not simple:
        clean = clean.where(F.length("text") > 0)
    order = ["pos"] if simple else ["y", "pos"]
    parts = in_parts(clean.select(*by, *order, "text"), by, order, "part_no", size=part_size)
    merged = parts.groupBy(*by, "part_no").agg(F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("_l"))
    glue = " " if simple else sep
    joined = F.array_join(F.transform("_l", lambda r: r.getField("text")), glue)
    texts = merged.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part_no", joined.alias("text")))).alias("_p"))
    whole = F.array_join(F.transform("_p", lambda r: r.getField("text")), glue)
    return texts.select(*by, (strip(whole) if simple else whole).alias("text"))


def text_or_fallback(local: Column | str, cloud: Column | str) -> tuple[Column, Column]:
    """(text, engine): the local text unless blank, else the cloud text."""
    local, cloud = (F.col(c) if isinstance(c, str) else c for c in (local, cloud))
    has = F.coalesce(F.length(strip(local)) > 0, F.lit(False))
    text = F.when(has, local).otherwise(F.coalesce(cloud, F.lit("")))
    return text, F.when(has, F.lit("paddle")).otherwise(F.lit("siliconflow"))


# Encodings a UTF-8 name may have been misread in.
MISREAD_AS = ("latin-1", "cp1252", "cp1251")


def _read_again(text: Column, encoding: str) -> Column:
    """The text's bytes in ``encoding`` read as UTF-8; null where it has other characters or the bytes are no UTF-8."""
    # The upper half of a code page, as characters: what the code page has there, and the same byte in Latin-1.
    pairs = []
    for code in range(0x80, 0x100):
        try:
            pairs.append((bytes([code]).decode(encoding), chr(code)))
        except UnicodeDecodeError:
            continue
    here = "".join(a for a, _ in pairs)
    known = F.length(F.translate(text, here, "")) == F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    plain = F.translate(text, here, "".join(b for _, b in pairs))
    raw = F.when(known, F.encode(F.when(known, plain), "ISO-8859-1"))
    return F.try_validate_utf8(raw.cast("string"))


def repair_mojibake(text: Column | str) -> Column:
    """The first re-reading of the trimmed text that differs from it, else the trimmed text; null if nothing is left."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(F.btrim(strip(text), F.lit('"')), F.lit("'"))
    readings = [_read_again(trimmed, encoding) for encoding in MISREAD_AS]
    return F.nullif(F.coalesce(*[F.when(r != trimmed, r) for r in readings], trimmed), F.lit(""))
