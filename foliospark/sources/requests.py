"""JSON-lines page requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_TYPE = ("image_b64 string, page_num int, global_order_start int, output_dir string, use_sam boolean, "
                "reading_order boolean, rtl boolean, _bad string")


def parse_requests(lines: DataFrame) -> DataFrame:
    """``value`` lines to requests with defaults; a bad line becomes a row with ``error``, blank lines vanish."""
    filled = lines.where(F.length(F.btrim("value")) > 0)
    parsed = filled.select(F.from_json("value", REQUEST_TYPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    data = F.try_to_binary("r.image_b64", F.lit("base64"))
    error = (F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.lit("invalid JSON"))
             .when(F.col("r.image_b64").isNull(), F.lit("image_b64 missing"))
             .when(F.col("r.output_dir").isNull(), F.lit("output_dir missing"))
             .when(data.isNull(), F.lit("image_b64 is not base64")))
    return parsed.select(
        F.coalesce("r.page_num", F.lit(1)).alias("page_num"),
        F.coalesce("r.global_order_start", F.lit(0)).alias("global_order_start"),
        F.col("r.output_dir").alias("output_dir"),
        F.coalesce("r.use_sam", F.lit(False)).alias("use_sam"),
        F.coalesce("r.reading_order", F.lit(True)).alias("reading_order"),
        F.coalesce("r.rtl", F.lit(False)).alias("rtl"),
        data.alias("data"), error.alias("error"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of JSON-lines files."""
    return parse_requests(spark.read.text(path))
