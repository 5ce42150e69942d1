"""Query logs: lines ``COMMAND<TAB>QUERY``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of a text file, one query a line."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def logged_queries(log: DataFrame) -> DataFrame:
    """``query_id, query``, one row per ``query_id``: that of the latest ``asked_at``.

    ``query`` is null for null lines and lines without a command; rows without a
    ``query_id`` are left out.
    """
    rows = log.where("query_id IS NOT NULL").groupBy("query_id").agg(F.max(F.struct("asked_at", "line")).alias("_row"))
    parts = F.split(F.col("_row.line"), "\t")
    return rows.select("query_id", F.get(parts, F.lit(1)).alias("query"))
