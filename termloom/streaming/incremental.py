"""Postings of documents that arrive as a stream.

A document's postings depend on that document alone, so each micro-batch is
indexed by itself and appended; term statistics are sums over the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.postings import build_postings, dictionary


def index_stream(documents: DataFrame, path: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text", **trigger) -> StreamingQuery:
    """Start a stream that appends the postings of arriving documents to ``path``.

    A batch that is run again after a failure replaces what it wrote before: each
    has its own partition ``batch``. A document that comes again in a later batch
    is indexed again, and its latest text is what ``read_streamed`` shows; of rows
    of one document in one batch any one is taken. Rows without a ``doc_id`` are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = batch.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
        # Written in this order, so that a batch's postings are never read without its documents.
        postings = build_postings(once, doc_id, text)
        once.select(F.col(doc_id).cast("bigint").alias("doc_id")).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
        postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_streamed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings of all batches so far, one per term and document, and their dictionary.

    Of a document that arrived several times only the last batch's postings stay;
    the pairs of document and batch that are out of date are few, and all that is joined.
    """
    arrived = spark.read.parquet(f"{path}/documents").select("doc_id", F.col("batch").cast("bigint").alias("batch"))
    times = arrived.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    outdated = arrived.join(times, "doc_id").where("batch < last").select("doc_id", "batch")
    postings = spark.read.parquet(f"{path}/postings").withColumn("batch", F.col("batch").cast("bigint"))
    current = postings.join(outdated, ["doc_id", "batch"], "left_anti").select("term", "doc_id", "tf")
    return current, dictionary(current)


def running_counts(documents: DataFrame, arrived: str, text: str = "text", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``start, n_docs`` per window of arrival time of a stream, with a watermark for late documents."""
    shown = documents.where(F.col(text).isNotNull()).withWatermark(arrived, late)
    return shown.groupBy(F.window(arrived, window).alias("w")).agg(F.count(F.lit(1)).alias("n_docs")).select(F.col("w.start").alias("start"), "n_docs")
