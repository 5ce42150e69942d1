"""Queries over the test tables, one or more per problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.analysis import compared_form, tokens
from termloom.llm.distinctive import score_postings
from termloom.llm.encode import token_counts, token_ids
from termloom.llm.frequency import record_totals, term_frequencies
from termloom.llm.heavy_values import heavy_values
from termloom.llm.lookalike import compared_text, printed_text, same_looking_classes, same_looking_pairs
from termloom.llm.overlap import overlap_sizes
from termloom.llm.packing import pack
from termloom.llm.truncation import truncated_texts, truncation_rates
from termloom.session import materialise
from termloom.sources.tables import items, meta_rows, table

CAPACITY = 2048


def _occurrences(spark: SparkSession, folder: str) -> DataFrame:
    # Written once, as the texts are read twice.
    texts = materialise(items(table(spark, folder, "wiki_item")).select("text"), "texts")
    return texts.select(F.explode(tokens("text")).alias("term"))


def p1_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """term, n, n_approx: the most frequent terms of all items."""
    return heavy_values(_occurrences(spark, folder), "term", share=1 / 140)


def p1_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return p1_sketch(spark, folder).select("term", "n")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_sketch(spark, folder).select("term")


def p3_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """id, canonical, compared: the consistent forms of every item's text, for reading and for comparing."""
    return items(table(spark, folder, "wiki_item")).select("id", printed_text("text").alias("canonical"), compared_text("text").alias("compared"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """id, look, spelling, spellings, links of every item with other spellings."""
    return same_looking_classes(table(spark, folder, "wiki_item"), "id", "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_looking_pairs(table(spark, folder, "wiki_item"), "id", "text")


def _scores(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    counted = items(table(spark, folder, "wiki_item")).select("seq", tokens("text").alias("terms"))
    long = counted.where(F.size("terms") > 0).select(
        "seq", F.size("terms").cast("bigint").alias("length"), F.posexplode("terms").alias("place", "term")
    )
    postings = long.groupBy("seq", "length", "term").agg(F.count(F.lit(1)).alias("tf"), (F.min("place") == 0).alias("first"))
    return score_postings(materialise(postings, "postings"))


def _weighed(spark: SparkSession, folder: str) -> DataFrame:
    scored, records = _scores(spark, folder)
    weight = F.col("tf") / F.col("length") * F.log(F.lit(records) / F.col("df")) / F.log(F.lit(float(max(records, 2))))
    return scored.select("seq", "term", "tf", "df", weight.alias("tfidf"), "elite")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    """seq, term, tf, df, tfidf, elite of every item's terms, rounded, so that another fit in floating point gives the same."""
    return _weighed(spark, folder).select("seq", "term", "tf", "df", *[F.round(c, 6).alias(c) for c in ("tfidf", "elite")])


#: Terms an item is more likely about than not.
ELITE = 0.5


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The posterior picks the candidates; counts and weights are then checked exactly."""
    return _weighed(spark, folder).where(F.col("elite") >= ELITE).where("tf >= 3 AND tfidf >= 0.0377").select("seq", "term")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """space, set, member, word of the watched terms in both origins: single members, or 64 of them in a word."""
    watched = table(spark, folder, "watch_term").where("term IS NOT NULL").select("term").distinct()
    listed = table(spark, folder, "posting_batch").select("term", "postings").join(watched, "term")
    items_of = listed.select(F.lit("posting_batch").alias("space"), F.col("term").alias("set"), F.explode("postings").alias("member"))
    marked = table(spark, folder, "term_meta_temp").select(compared_form("term").alias("term"), "distribution").join(watched, "term")
    outer = marked.select("term", F.posexplode("distribution").alias("part", "inner"))
    inner = outer.select("term", "part", F.posexplode("inner").alias("at", "word")).where("word <> 0")
    # A block's number: partition in the high bits, then the word; the word holds 64 blocks already.
    place = (F.col("part").cast("bigint") * (1 << 32) + F.col("at")) * 64
    blocks = inner.groupBy("term", place.alias("member")).agg(F.bit_or("word").alias("word"))
    both = blocks.select(F.lit("term_meta_temp").alias("space"), F.col("term").alias("set"), "member", "word")
    return items_of.withColumn("word", F.lit(None).cast("bigint")).unionByName(both)


def p5_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """origin, term_a, term_b, n_a, n_b, shared of every two watched terms that share a member."""
    origins = F.explode(F.array(F.lit("posting_batch"), F.lit("term_meta_temp"))).alias("space")
    sets = table(spark, folder, "watch_term").where("term IS NOT NULL").select(origins, F.col("term").alias("set"))
    sizes = overlap_sizes(_members(spark, folder), sets)
    return sizes.select(
        F.col("space").alias("origin"), F.col("set_a").alias("term_a"), F.col("set_b").alias("term_b"), "n_a", "n_b", "shared"
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    close = (F.col("shared") >= 5) & (2 * F.col("shared") >= F.col("n_a") + F.col("n_b") - F.col("shared"))
    return p5_overlaps(spark, folder).where(close).select("origin", "term_a", "term_b")


def p6_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """origin, term, occurrences, records, mark of every term.

    For ``term_meta_temp``, ``occurrences`` are documents and ``records`` metas.
    """
    wiki = table(spark, folder, "wiki_item")
    texts = wiki.where("seq IS NOT NULL AND text IS NOT NULL").agg(F.count_distinct("seq")).first()[0]
    counted = term_frequencies(items(wiki).select("seq", tokens("text").alias("terms")), "seq", "terms", arranged=True)
    mark = F.when(F.col("records") <= 2, "rare").when(F.col("records") * 5 >= 2 * texts, "common")
    ours = counted.select(F.lit("wiki_item").alias("origin"), "term", "occurrences", "records", mark.alias("mark"))
    spills = meta_rows(table(spark, folder, "term_meta_temp"))
    summed = record_totals(spills, "meta_id", "term", ["docs", "blocks"], latest="built_at").where("term IS NOT NULL")
    mark = F.when(F.col("docs") <= 2, "rare").when(F.col("docs") * 2 >= 512 * F.col("blocks"), "common")
    theirs = summed.select(F.lit("term_meta_temp").alias("origin"), "term", F.col("docs").alias("occurrences"), "records", mark.alias("mark"))
    return ours.unionByName(theirs)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_frequencies(spark, folder).where("mark IS NOT NULL").select("origin", "term", "mark")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, piece, pieces, length, container, start: where every document goes."""
    return pack(token_counts(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """container, pieces, used: how full every container is."""
    placed = p8_packing(spark, folder).where("container IS NOT NULL")
    return placed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("used"))


def p8_violations(spark: SparkSession, folder: str) -> DataFrame:
    """documents, and how much of the packing breaks a rule: all but the first must be 0.

    ``without_place``: tokens that are in no container; ``over_capacity`` and
    ``overlaps``: containers with more than they hold, or whose pieces do not follow
    each other without a gap; ``needless_cuts``: documents in pieces though they fit.
    """
    sizes = materialise(token_counts(table(spark, folder, "documents"), "doc_id", "text"), "sizes")
    placed = materialise(pack(sizes, "doc_id", "n_tokens", CAPACITY), "placed")
    # At most ``CAPACITY`` pieces to a container; pieces from 0 on fill it without overlap if each but the first begins at another's end.
    ends = F.array_sort(F.collect_list(F.col("start") + F.col("length")))
    boxes = placed.where("container IS NOT NULL").groupBy("container").agg(
        F.sum("length").alias("used"), ends.alias("ends"), F.array_sort(F.collect_list("start")).alias("starts")
    )
    tiled = (F.get("starts", F.lit(0)) == 0) & (F.slice("starts", 2, F.size("starts")) == F.slice("ends", 1, F.size("ends") - 1))
    none = F.lit(0).cast("bigint")
    rules = ("documents", "without_place", "over_capacity", "overlaps", "needless_cuts")
    row = lambda **found: [found.get(r, none).alias(r) for r in rules]
    parts = [
        boxes.agg(*row(over_capacity=F.count_if(F.col("used") > CAPACITY), overlaps=F.count_if(~tiled), without_place=-F.sum("used"))),
        sizes.agg(*row(documents=F.count(F.lit(1)), without_place=F.sum("n_tokens"))),
        placed.groupBy("doc_id").agg(F.max("pieces").alias("pieces"), F.sum("length").alias("n")).agg(
            *row(needless_cuts=F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)))
        ),
    ]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.agg(*[F.coalesce(F.sum(r), none).alias(r) for r in rules])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_packing(spark, folder).where("pieces > 1").select("doc_id").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated_texts(table(spark, folder, "documents"), "doc_id", "source", "text").where("truncated").select("doc_id")


def p9_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """evidence, documents: how many of the cut texts show in their length, their ending, or both."""
    found = truncated_texts(table(spark, folder, "documents"), "doc_id", "source", "text").where("truncated")
    return found.groupBy("evidence").agg(F.count(F.lit(1)).alias("documents"))


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """source, texts, truncated, share, by_length, by_ending, limits."""
    return truncation_rates(table(spark, folder, "documents"), "doc_id", "source", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_top_terms, p1_sketch, p3_found, p3_classes, p3_canonical, p4_found, p4_scores, p5_found, p5_overlaps,
            p6_found, p6_frequencies, p7_ids, p8_found, p8_packing, p8_containers, p8_violations, p9_found, p9_evidence, p9_sources,
        )
    }
