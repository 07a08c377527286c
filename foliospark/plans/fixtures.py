"""Page, box, bubble and catalogue views derived by fixed integer formulas from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazily opened parquet tables of one data folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def page(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey AS page_id", "o_custkey AS source_id", "format_string('%08d.png', o_orderkey) AS name",
            "CAST(1000 + o_orderkey % 200 AS INT) AS w", "CAST(1400 + o_orderkey % 300 AS INT) AS h")

    def det(self) -> DataFrame:
        return (
            self.read("lineitem")
            .selectExpr(
                "l_orderkey AS page_id",
                "CAST((l_partkey * 37) % 700 AS INT) AS x1",
                "CAST((l_partkey * 91 + l_linenumber * 53) % 1000 AS INT) AS y1",
                "CAST(150 + (l_suppkey * 13) % 300 AS INT) AS bw",
                "CAST(120 + CAST(l_quantity AS INT) * 6 AS INT) AS bh",
                "CAST(100 + (l_partkey * 17 + l_suppkey * 29 + l_linenumber * 7) % 900 AS INT) AS score",
                "CAST(l_linenumber % 2 AS INT) AS class_id")
            .selectExpr("page_id", "x1", "y1", "x1 + bw AS x2", "y1 + bh AS y2", "score", "class_id")
        )

    def bubble(self) -> DataFrame:
        return (
            self.read("conversations")
            .selectExpr(
                "conv_id AS panel_id", "concat(conv_id, '_b', turn) AS bubble_id", "turn AS pos",
                "CASE WHEN turn % 3 <> 0 THEN turn END AS reading_order", "text AS raw_text",
                "CAST((turn % 2) * 300 + (conv_id * 13) % 60 AS INT) AS x1",
                "CAST((turn div 2) * 90 + (conv_id * 7) % 40 AS INT) AS y1",
                "CAST(200 + turn * 5 AS INT) AS bw", "CAST(80 + (conv_id % 3) * 20 AS INT) AS bh")
            .selectExpr("panel_id", "bubble_id", "pos", "reading_order", "raw_text",
                        "x1", "y1", "x1 + bw AS x2", "y1 + bh AS y2")
        )


# The same views for the check engine.
CTE = {
    "page": """page AS (
  SELECT o_orderkey AS page_id, o_custkey AS source_id, printf('%08d.png', o_orderkey) AS name,
         CAST(1000 + o_orderkey % 200 AS INT) AS w, CAST(1400 + o_orderkey % 300 AS INT) AS h
  FROM orders)""",
    "det": """det AS (
  SELECT page_id, x1, y1, x1 + bw AS x2, y1 + bh AS y2, score, class_id FROM (
    SELECT l_orderkey AS page_id,
           CAST((l_partkey * 37) % 700 AS INT) AS x1,
           CAST((l_partkey * 91 + l_linenumber * 53) % 1000 AS INT) AS y1,
           CAST(150 + (l_suppkey * 13) % 300 AS INT) AS bw,
           CAST(120 + CAST(l_quantity AS INT) * 6 AS INT) AS bh,
           CAST(100 + (l_partkey * 17 + l_suppkey * 29 + l_linenumber * 7) % 900 AS INT) AS score,
           CAST(l_linenumber % 2 AS INT) AS class_id
    FROM lineitem))""",
    "bubble": """bubble AS (
  SELECT conv_id AS panel_id, conv_id || '_b' || turn AS bubble_id, turn AS pos,
         CASE WHEN turn % 3 <> 0 THEN turn END AS reading_order, text AS raw_text,
         CAST((turn % 2) * 300 + (conv_id * 13) % 60 AS INT) AS x1,
         CAST((turn // 2) * 90 + (conv_id * 7) % 40 AS INT) AS y1,
         CAST((turn % 2) * 300 + (conv_id * 13) % 60 + 200 + turn * 5 AS INT) AS x2,
         CAST((turn // 2) * 90 + (conv_id * 7) % 40 + 80 + (conv_id % 3) * 20 AS INT) AS y2
  FROM conversations)""",
}
