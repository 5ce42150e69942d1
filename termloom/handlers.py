"""What the command line can run over a corpus of JSON lines: one handler per way of answering queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.context import BooleanContext
from termloom.functions.analysis import split_words
from termloom.operators import matrix
from termloom.operators.batch import count_queries
from termloom.operators.postings import sample_terms
from termloom.plans.planner import BLOCK
from termloom.session import materialise, scratch_path
from termloom.sources.index_store import build_index, load_index, save_index

#: Words drawn for the timed pairs of queries.
SAMPLE = 100
#: Word columns of a vertical part.
WIDTH = 10


def _matrix(documents: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """A dense matrix of sampled words, written once, and pairs of its columns."""
    words = sample_terms(documents.select(F.explode(split_words("text")).alias("term")).distinct(), SAMPLE)
    found = [r["term"] for r in words.collect()]  # at most SAMPLE
    names = list(matrix.word_columns(found).values())
    return materialise(matrix.dense_matrix(documents, found), "matrix"), list(zip(names[::2], names[1::2]))


def _pairs(results: list[tuple[str, str, DataFrame]], spark: SparkSession) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n") for a, b, df in results]
    return reduce(DataFrame.unionByName, counts, spark.createDataFrame([], "a string, b string, n bigint"))


def base(spark: SparkSession, documents: DataFrame, **_) -> DataFrame:
    """``a, b, n`` of pairs of words, in one pass over the whole matrix."""
    cells, pairs = _matrix(documents)
    return matrix.pair_counts(cells, pairs) if pairs else _pairs([], spark)


def _split(same_part: bool) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, documents: DataFrame, **_) -> DataFrame:
        cells, pairs = _matrix(documents)
        parts = matrix.vertical_split(cells, WIDTH)
        place = {c: i for i, part in enumerate(parts) for c in part.columns}
        results = []
        for a, b in pairs:
            left, right = parts[place[a]], parts[place[b]]
            if same_part and place[a] == place[b]:
                results.append((a, b, matrix.bitand(left, a, b)))
            else:
                results.append((a, b, (matrix.join_bitand if same_part else matrix.join_split)(left, right, a, b)))
        return _pairs(results, spark)

    return run


def load_data(spark: SparkSession, documents: DataFrame, **_) -> DataFrame:
    """``n_docs, n_texts``: what the corpus holds."""
    return documents.agg(F.count(F.lit(1)).alias("n_docs"), F.count("text").alias("n_texts"))


def _index(spark: SparkSession, documents: DataFrame, dump: str | None, size: int):
    path = dump or scratch_path(spark, "index")
    save_index(build_index(documents, size=size), path, mode="overwrite")
    return load_index(spark, path)


def posting_table(spark: SparkSession, documents: DataFrame, dump: str | None = None, size: int = BLOCK, **_) -> DataFrame:
    """``query_id, n`` of conjunctions of sampled terms on a written index."""
    index = _index(spark, documents, dump, size)
    terms = [r["term"] for r in sample_terms(index.terms.where(F.col("term").rlike("^[a-z0-9]+$")), SAMPLE).collect()]
    asked = [(i, f"{a} AND {b}") for i, (a, b) in enumerate(zip(terms[::2], terms[1::2]))]
    return count_queries(spark.createDataFrame(asked, "query_id bigint, query string"), index.postings)


def boolean_query(spark: SparkSession, documents: DataFrame, dump: str | None = None, size: int = BLOCK, queries: list[str] = (), **_) -> DataFrame:
    """``query_id, n`` of given queries on a written index."""
    context = BooleanContext(spark)
    context.register_index("corpus", _index(spark, documents, dump, size))
    return context.count_all("corpus", spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string"))


HANDLERS: dict[str, Callable[..., DataFrame]] = {
    "base": base,
    "split-base": _split(False),
    "split-o1": _split(True),
    "load-data": load_data,
    "posting-table": posting_table,
    "boolean-query": boolean_query,
}
