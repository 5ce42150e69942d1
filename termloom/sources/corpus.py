"""Readers of JSON-lines corpora: one object ``{"id": ..., "text": ...}`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.ranking import global_rank

SCHEMA = "id string, text string"


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` of one file; a line that is no JSON object gives a row of nulls."""
    return spark.read.schema(SCHEMA).json(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` of all files below a directory, however deep."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(path)


def read_paths(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    """``id, text, path`` of several directories or files below ``base``."""
    full = [f"{base.rstrip('/')}/{p}" if base else p for p in paths]
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(full).withColumn("path", F.col("_metadata.file_path"))


def number_documents(corpus: DataFrame) -> DataFrame:
    """``doc_id, id, text``: documents numbered densely from 0 in order of ``id``, the same way every time ids are unique."""
    return global_rank(corpus.select("id", "text"), ["id"], "doc_id").select("doc_id", "id", "text")
