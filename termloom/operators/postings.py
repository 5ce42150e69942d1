"""Postings and what is derived from them: dictionary, blocks, chunk encodings, bitmaps.

``postings`` is the long table ``term, doc_id, tf``, one row per term and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.analysis import raw_tokens, tokens
from termloom.operators.ranking import global_rank
from termloom.plans.planner import BLOCK
from termloom.session import spread

#: A block with more documents is kept as a bitmap, the others as lists of offsets; the last block of a term from this many on.
DENSE_OVER, DENSE_LAST = 32, 16


def block_of(doc_id: Column | str = "doc_id", size: int = BLOCK) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.floor(column / F.lit(size)).cast("bigint")


def build_postings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, tf`` of all documents; null texts and ids have none.

    One shuffle on term and document with counts combined before it, so a term
    that is in every document is spread like any other.
    """
    texts = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = spread(texts).select("doc_id", F.explode(tokens("text")).alias("term"))
    return rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_terms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id`` of all documents without counts and without a shuffle; a document of several rows may have a term several times."""
    texts = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(texts).select(F.explode(F.array_distinct(tokens("text"))).alias("term"), "doc_id")


def term_blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """``term, block, n_docs``: documents of each term in each block."""
    return postings.groupBy("term", block_of(size=size).alias("block")).agg(F.count(F.lit(1)).alias("n_docs"))


def dictionary(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """``term, df, ctf, n_blocks, selectivity`` with ``selectivity = df / (size * n_blocks)``.

    Counted per block first, so that blocks need no distinct count.
    """
    blocks = postings.groupBy("term", block_of(size=size).alias("block")).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    terms = blocks.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"), F.count(F.lit(1)).alias("n_blocks"))
    return terms.withColumn("selectivity", F.col("df") / (F.lit(size) * F.col("n_blocks")))


def chunks(postings: DataFrame) -> DataFrame:
    """``term, block, n_docs, encoding, n_bytes``: ``bitmap`` or ``ids`` for every block of a term."""
    last = F.col("block") == F.max("block").over(Window.partitionBy("term"))
    dense = (F.col("n_docs") > DENSE_OVER) | (last & (F.col("n_docs") >= DENSE_LAST))
    encoded = term_blocks(postings).withColumn("encoding", F.when(dense, "bitmap").otherwise("ids"))
    return encoded.withColumn("n_bytes", F.when(F.col("encoding") == "bitmap", F.lit(BLOCK // 8)).otherwise(2 * F.col("n_docs")).cast("bigint"))


def chunk_report(postings: DataFrame) -> DataFrame:
    """``encoding, n_chunks, n_postings, n_bytes`` over all terms: the build's counters and memory."""
    return chunks(postings).groupBy("encoding").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("n_docs").alias("n_postings"), F.sum("n_bytes").alias("n_bytes")
    )


def distribution_runs(postings: DataFrame) -> DataFrame:
    """``term, n_runs``: maximal runs of consecutive blocks that hold the term."""
    gap = F.col("block") - F.lag("block").over(Window.partitionBy("term").orderBy("block"))
    starts = term_blocks(postings).select("term", F.when(gap == 1, 0).otherwise(1).alias("start"))
    return starts.groupBy("term").agg(F.sum("start").cast("bigint").alias("n_runs"))


def build_bitmaps(postings: DataFrame) -> DataFrame:
    """``term, bucket, bitmap``: the documents of a term in bitmaps of 32,768 bits."""
    bit = F.col("doc_id") + 1  # bucket 0 would hold the value 0 alone
    return postings.groupBy("term", F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))


def prefix_terms(terms: DataFrame, prefix: str) -> DataFrame:
    """The dictionary's rows whose term begins with ``prefix``; a range of a table sorted by term."""
    return terms.where(F.col("term").startswith(prefix))


def lookup(terms: DataFrame, words: list[str]) -> DataFrame:
    """The dictionary's rows of the given terms."""
    return terms.where(F.col("term").isin(sorted(set(words))))


def term_groups(terms: DataFrame, size: int = 100) -> DataFrame:
    """``term, term_id, term_group``: terms numbered from 0 in order, and dealt into groups of ``size``."""
    ranked = global_rank(terms.select("term"), ["term"], "term_id")
    return ranked.withColumn("term_group", F.floor(F.col("term_id") / size).cast("bigint"))


def sample_terms(terms: DataFrame, n: int = 100) -> DataFrame:
    """``n`` terms that look drawn at random, the same ones every time: those whose MD5 comes first."""
    return terms.select("term").orderBy(F.md5(F.col("term").cast("binary")), "term").limit(n)


#: Common English words without which word lengths are counted (fixed values).
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)


def word_length_histogram(documents: DataFrame, text: str = "text", stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """``n_bytes, n_words``: how many words of the texts, stop words left out, have each length in UTF-8.

    Every occurrence counts. Words are taken as stored, of any length and case, so
    a capitalised stop word is a word like others.
    """
    words = spread(documents.select(F.col(text).alias("text"))).select(F.explode(raw_tokens("text")).alias("word"))
    kept = words.where(~F.col("word").isin(list(stop_words))) if stop_words else words
    return kept.groupBy(F.octet_length("word").cast("bigint").alias("n_bytes")).agg(F.count(F.lit(1)).alias("n_words"))


def corpus_running_total(documents: DataFrame, source: str = "source") -> DataFrame:
    """``source, n_docs, running``: documents per source and their running total in order of the sources."""
    counts = documents.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    # One row per source by now.
    running = F.sum("n_docs").over(Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("running", running)
