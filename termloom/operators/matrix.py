"""The dense baseline: one 0/1 column per chosen word, and tables of word columns split vertically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.analysis import split_words


def word_columns(words: list[str]) -> dict[str, str]:
    """Column name of each word, by position: words may clash in case or need quoting."""
    return {w: f"w{i}" for i, w in enumerate(words)}


def dense_matrix(documents: DataFrame, words: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and a column ``w0, w1, ...`` of 0 or 1 per word (upper-case); every document has a row. No shuffle."""
    held = documents.select(F.col(doc_id).alias("doc_id"), split_words(text).alias("_words"))
    cells = [F.coalesce(F.array_contains("_words", w), F.lit(False)).cast("tinyint").alias(n) for w, n in word_columns(words).items()]
    return held.select("doc_id", *cells)


def vertical_split(matrix: DataFrame, width: int = 100) -> list[DataFrame]:
    """Tables of up to ``width`` word columns each, all with ``doc_id``."""
    columns = [c for c in matrix.columns if c != "doc_id"]
    return [matrix.select("doc_id", *columns[i : i + width]) for i in range(0, len(columns), width)]


def join_split(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Documents with word ``a`` in one vertical part and ``b`` in another: the filters go below the join."""
    ones = left.where(F.col(a) == 1).select("doc_id", a), right.where(F.col(b) == 1).select("doc_id", b)
    return ones[0].join(ones[1], "doc_id")


def join_bitand(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """As ``join_split``, by the bitwise and of the two cells after the join."""
    both = left.select("doc_id", a).join(right.select("doc_id", b), "doc_id")
    return both.withColumn("cache", F.col(a).bitwiseAND(F.col(b))).where(F.col("cache") == 1).drop("cache")


def bitand(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """The same within one part: no join."""
    return matrix.select("doc_id", a, b).withColumn("cache", F.col(a).bitwiseAND(F.col(b))).where(F.col("cache") == 1).drop("cache")


def bitor(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """Documents with either word, by the bitwise or of the cells."""
    return matrix.select("doc_id", a, b).withColumn("cache", F.col(a).bitwiseOR(F.col(b))).where(F.col("cache") == 1).drop("cache")


def pair_counts(matrix: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, n``: documents with both words of every pair of columns, all pairs in one pass over the matrix."""
    counts = [F.coalesce(F.sum(F.col(a).bitwiseAND(F.col(b)).cast("bigint")), F.lit(0)) for a, b in pairs]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n")) for (a, b), n in zip(pairs, counts)]
    return matrix.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
