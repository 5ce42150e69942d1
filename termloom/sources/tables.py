"""The tables of a data folder, and their records counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.analysis import compared_form, list_total, set_bits


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(wiki_item: DataFrame) -> DataFrame:
    """``seq, id, text``, one row per item: that of the latest ``read_at``.

    Rows with a null ``seq`` belong to no item and are left out. One shuffle on
    ``seq``, which later groupings by ``seq`` reuse.
    """
    rows = wiki_item.select("seq", F.struct("read_at", "id", "text").alias("_row")).where("seq IS NOT NULL")
    latest = rows.repartition("seq").groupBy("seq").agg(F.max("_row").alias("_row"))
    return latest.select("seq", F.col("_row.id").alias("id"), F.col("_row.text").alias("text"))


def meta_rows(term_meta_temp: DataFrame) -> DataFrame:
    """``meta_id, built_at, term, nums_total, docs, blocks`` of every row that belongs to a meta.

    ``term`` is in compared form. ``nums_total`` is the sum of ``nums`` (null if
    the list is), ``blocks`` the set bits of ``distribution`` and ``docs`` the
    number of documents: ``nums_total``, or where that is null the rounded
    ``selectivity * 512 * blocks`` (null if ``selectivity`` is null, negative or
    not finite). Rows without ``meta_id`` are left out.
    """
    blocks, total = set_bits("distribution"), list_total("nums")
    # NaN is greater than any number here, infinity included.
    sound = F.col("selectivity").isNotNull() & (F.col("selectivity") >= 0) & (F.col("selectivity") < float("inf"))
    rows = term_meta_temp.where("meta_id IS NOT NULL").select(
        "meta_id", "built_at", compared_form("term").alias("term"), "selectivity", total.alias("nums_total"), blocks.alias("blocks")
    )
    estimated = F.when(sound, F.round(F.col("selectivity") * 512 * F.col("blocks")).cast("bigint"))
    return rows.select("meta_id", "built_at", "term", "nums_total", F.coalesce("nums_total", estimated).alias("docs"), "blocks")


def metas(term_meta_temp: DataFrame) -> DataFrame:
    """``meta_id, term, nums_total, docs, blocks``, one row per meta: that of the latest ``built_at``; see ``meta_rows``."""
    small = meta_rows(term_meta_temp).select("meta_id", F.struct("built_at", "term", "nums_total", "docs", "blocks").alias("_row"))
    return small.repartition("meta_id").groupBy("meta_id").agg(F.max("_row").alias("_row")).select(
        "meta_id", "_row.term", "_row.nums_total", "_row.docs", "_row.blocks"
    )
