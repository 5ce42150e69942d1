"""An index on disk: ``postings``, ``terms`` and ``documents`` as Parquet tables sorted for their lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.postings import build_postings, dictionary
from termloom.plans.planner import BLOCK

TABLES = ("postings", "terms", "documents")


@dataclass(frozen=True)
class Index:
    """The tables of an index; ``documents`` has the ids alone."""

    postings: DataFrame
    terms: DataFrame
    documents: DataFrame
    size: int = BLOCK


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> Index:
    """An index of documents, not yet written; its statistics are by blocks of ``size`` documents."""
    postings = build_postings(documents, doc_id, text)
    ids = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id")).distinct()
    return Index(postings, dictionary(postings, size), ids, size)


def save_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Write an index. Postings are ordered by term, so a query's terms are a few row groups.

    Ranges are cut by term and document: a frequent term fills several files.
    """
    spread = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    spread.write.mode(mode).parquet(f"{path}/postings")
    written = index.postings.sparkSession.read.parquet(f"{path}/postings")
    dictionary(written, index.size).repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
    index.documents.write.mode(mode).parquet(f"{path}/documents")


def load_index(spark: SparkSession, path: str) -> Index | None:
    """A written index, or None if any of its tables is missing or was not finished."""
    context = spark.sparkContext
    for name in TABLES:
        done = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if not done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done):
            return None
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def load_or_build(spark: SparkSession, path: str, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index at ``path``, built and written first if it is not whole."""
    found = load_index(spark, path)
    if found is None:
        save_index(build_index(documents, doc_id, text), path, mode="overwrite")
        found = load_index(spark, path)
    return found
