"""Matching documents of a query tree, by several strategies with one result.

Every strategy but the forward scan reads only the query's terms, a filter that
reaches the scan of a table sorted by term, and shuffles on the document, which
no frequent term can skew. ``postings`` has one row per term and document; the
aggregating strategies do not depend on that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.analysis import tokens
from termloom.operators.postings import block_of
from termloom.plans.ast import FALSE, And, Node, Not, Or, Term, matches_nothing_at_all, possible, rebuild, terms_of, to_column
from termloom.plans.planner import BLOCK, Plan
from termloom.session import spread


def _of_terms(postings: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    return postings.where(F.col("term").isin(list(terms)))


def by_pivot(postings: DataFrame, node: Node, documents: DataFrame | None = None) -> DataFrame:
    """``doc_id``: one aggregation to a flag per term and document, then the tree as a filter.

    ``documents`` (``doc_id``) is needed for trees that match documents without any of their terms.
    """
    terms = terms_of(node)
    names = {t: f"t{i}" for i, t in enumerate(terms)}  # terms may need quoting, positions do not
    flags = _of_terms(postings, terms).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(n) for t, n in names.items()])
    if matches_nothing_at_all(node):
        if documents is None:
            raise ValueError("this query matches documents without any of its terms: give the documents")
        flags = documents.select("doc_id").join(flags, "doc_id", "left").fillna(False, list(names.values()))
    return flags.where(to_column(node, {t: F.col(n) for t, n in names.items()}, F.lit(False))).select("doc_id")


#: Terms whose presence one 64-bit mask holds.
MASK_TERMS = 62


def flat_and(postings: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """Documents with all of the terms: a bit per term, and all bits set, however often a posting is repeated."""
    wanted = sorted(set(terms))
    parts = [wanted[i : i + MASK_TERMS] for i in range(0, len(wanted), MASK_TERMS)]
    masks = []
    for i, part in enumerate(parts):
        bit = reduce(lambda e, t: e.when(F.col("term") == t[1], F.lit(1 << t[0]).cast("bigint")), enumerate(part), F)
        masks.append(F.bit_or(bit).alias(f"m{i}"))
    found = _of_terms(postings, wanted).groupBy("doc_id").agg(*masks)
    return found.where(reduce(Column.__and__, (F.col(f"m{i}") == (1 << len(p)) - 1 for i, p in enumerate(parts)))).select("doc_id")


def flat_or(postings: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """Documents with any of the terms."""
    return _of_terms(postings, terms).select("doc_id").distinct()


def one_term(postings: DataFrame, term: str) -> DataFrame:
    """Documents with the term: no shuffle, as a term has one posting per document."""
    return postings.where(F.col("term") == term).select("doc_id")


def by_sets(postings: DataFrame, node: Node, documents: DataFrame | None = None) -> DataFrame:
    """``doc_id``: semi-joins for AND in the order of the tree, unions for OR, anti-joins for NOT.

    Every part of the tree is a set of documents or the rest of all documents
    outside of one; the latter are only made where the whole tree comes to that,
    which needs ``documents`` (``doc_id``).
    """
    union = lambda sets: reduce(DataFrame.union, sets).distinct() if len(sets) > 1 else sets[0]
    both = lambda sets: reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets)
    less = lambda found, sets: reduce(lambda a, b: a.join(b, "doc_id", "left_anti"), sets, found)

    def make(current: Node, below: tuple) -> tuple[bool, DataFrame]:
        if isinstance(current, Term):
            return True, one_term(postings, current.text)
        if isinstance(current, Not):
            return not below[0][0], below[0][1]
        if not isinstance(current, And | Or):
            return True, postings.select("doc_id").limit(0)
        inside, outside = ([d for kept, d in below if kept is side] for side in (True, False))
        if isinstance(current, And):
            return (True, less(both(inside), outside)) if inside else (False, union(outside))
        return (False, less(both(outside), inside)) if outside else (True, union(inside))

    kept, found = rebuild(node, make)
    if kept:
        return found
    if documents is None:
        raise ValueError("this query matches documents without any of its terms: give the documents")
    return documents.select("doc_id").join(found, "doc_id", "left_anti")


def bitmap_and(bitmaps: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """``bucket, bitmap``: documents with all terms; a bucket that lacks a term is left out."""
    wanted = sorted(set(terms))
    held = _of_terms(bitmaps, wanted).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("k"))
    return held.where(F.col("k") == len(wanted)).select("bucket", "bitmap")


def bitmap_and_count(bitmaps: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """``n``: documents with all terms, counted on bitmaps; a bucket that lacks a term has none."""
    return bitmap_and(bitmaps, terms).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def bitmap_or_count(bitmaps: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """``n``: documents with any of the terms, counted on bitmaps."""
    either = _of_terms(bitmaps, terms).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return either.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def by_scan(documents: DataFrame, node: Node, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``: every text tokenized and tested where it lies; no index, no shuffle."""
    texts = spread(documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")))
    held = texts.select("doc_id", F.coalesce(tokens("_text"), F.array().cast("array<string>")).alias("_terms"))
    leaves = {t: F.array_contains("_terms", t) for t in terms_of(node)}
    return held.where(to_column(node, leaves, F.lit(False))).select("doc_id")


def candidate_blocks(postings: DataFrame, node: Node, size: int = BLOCK) -> DataFrame:
    """``block``: blocks that can hold a match, the tree evaluated on which blocks hold its terms.

    A block that holds a term holds documents without it too, so a ``Not`` rules
    no block out. A tree that then rules out none at all is refused.
    """
    if (needed := possible(node)) is None:
        raise ValueError(f"any block can hold a match of {node}")
    return by_pivot(postings.select("term", block_of(size=size).alias("doc_id")), needed).withColumnRenamed("doc_id", "block")


def pruned(postings: DataFrame, node: Node, size: int = BLOCK) -> DataFrame:
    """The query's postings in its candidate blocks only; all of them if no block can be ruled out."""
    rows = _of_terms(postings, terms_of(node))
    if possible(node) is None:
        return rows
    return rows.withColumn("block", block_of(size=size)).join(candidate_blocks(postings, node, size), "block", "left_semi").drop("block")


def run(plan: Plan, postings: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``doc_id`` of the documents that match a plan."""
    node = plan.node
    if node == FALSE:
        return postings.select("doc_id").limit(0)
    if plan.strategy == "term":
        return one_term(postings, node.text)
    if plan.strategy == "all":
        return flat_and(postings, plan.terms)
    if plan.strategy == "any":
        return flat_or(postings, plan.terms)
    if plan.strategy == "semi":
        return by_sets(postings, node, documents)
    return by_pivot(postings, node, documents)


def with_frequencies(postings: DataFrame, matches: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """``doc_id, term, tf`` of the query's terms in the matching documents."""
    return _of_terms(postings, terms).join(matches, "doc_id", "left_semi").select("doc_id", "term", "tf")


def frequency_columns(postings: DataFrame, matches: DataFrame, terms: list[str] | tuple[str, ...]) -> DataFrame:
    """``doc_id`` and one column ``<term>_freq`` per term, 0 where a matching document lacks it."""
    rows = with_frequencies(postings, matches, terms)
    columns = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"{t}_freq") for t in terms]
    return rows.groupBy("doc_id").agg(*columns)


def count_valid(df: DataFrame, column: str) -> DataFrame:
    """``n``: rows in which a column is true (for booleans) or not null; partial counts, then their sum."""
    valid = F.col(column) if df.schema[column].dataType.typeName() == "boolean" else F.col(column).isNotNull()
    return df.agg(F.count_if(valid).alias("n"))
