"""Queries over the test tables, and the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.context import BooleanContext
from termloom.operators import boolean, containers, matrix, postings
from termloom.operators.batch import count_queries
from termloom.operators.skew import key_profile
from termloom.plans.ast import And, Node, Not, Or, Term, flatten, simplify
from termloom.plans.builder import BooleanPredicateBuilder
from termloom.plans.parser import parse_query
from termloom.session import scratch_path
from termloom.sources.corpus import number_documents, read_directory, read_paths
from termloom.sources.index_store import load_or_build
from termloom.sources.query_log import logged_queries
from termloom.sources.tables import items, metas, table

Query = Callable[[SparkSession, str], DataFrame]

#: Query text and, for SQL, its meaning with terms in braces.
BOOLEAN = {
    "and2": ("the AND of", "{the} AND {of}"),
    "and4": ("the AND castle AND of AND river", "{the} AND {castle} AND {of} AND {river}"),
    "or2": ("castle OR nicht", "{castle} OR {nicht}"),
    "or4": ("castle OR nicht OR riviere OR museo", "{castle} OR {nicht} OR {riviere} OR {museo}"),
    "nested_and_or": ("the AND (und OR nicht OR of)", "{the} AND ({und} OR {nicht} OR {of})"),
    "nested_or_and": ("castle OR (river AND museum)", "{castle} OR ({river} AND {museum})"),
    "deep_nested": (
        "the AND (castle OR (river AND (museum OR (village AND bridge))) OR und)",
        "{the} AND ({castle} OR ({river} AND ({museum} OR ({village} AND {bridge}))) OR {und})",
    ),
    "equal_precedence": ("castle OR river AND museum", "({castle} OR {river}) AND {museum}"),
    "implicit_should": ("castle museum bridge", "{castle} OR {museum} OR {bridge}"),
    "plus_must": ("+the +of +river", "{the} AND {of} AND {river}"),
    "plus_mixed": ("+the castle +museum", "{the} AND ({castle} OR {museum})"),
    "plus_group": ("+of +(castle museum)", "{of} AND ({castle} OR {museum})"),
    "multi_token_word": ("shard-01 OR film-festival", "({shard} AND {01}) OR ({film} AND {festival})"),
    "missing_in_and": ("the AND zzqqxx", "{the} AND {zzqqxx}"),
    "missing_in_or": ("castle OR zzqqxx", "{castle} OR {zzqqxx}"),
    "single_term": ("castle", "{castle}"),
    "duplicate_term": ("castle AND castle AND (castle OR river)", "{castle}"),
}
NESTED = BOOLEAN["nested_and_or"]
BATCH = ("and2", "nested_and_or", "nested_or_and", "equal_precedence", "missing_in_and", "plus_mixed")
#: Words of the dense matrix and of its vertical parts.
WORDS = ["CASTLE", "RIVER", "MUSEUM", "THE", "MARKT", "VIEILLE"]
BLOCK_TERMS = ["the", "of", "castle", "nicht"]
PREFIX = "mar"
#: Pairs of columns of the dense matrix.
PAIRS = [("w0", "w1"), ("w0", "w3"), ("w1", "w3"), ("w2", "w3"), ("w4", "w5")]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return postings.build_postings(_documents(spark, folder))


def _count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("n"))


def _boolean(text: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        context = BooleanContext(spark)
        context.index_documents("documents", _documents(spark, folder))
        return context.boolean("documents", text, use_stats=False).count_agg()

    return query


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _boolean(NESTED[0])(spark, folder)


def _over_postings(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(_postings(spark, folder))


def _tree(text: str) -> Node:
    return simplify(parse_query(text))


def tokenize_stats(spark: SparkSession, folder: str) -> DataFrame:
    terms = _postings(spark, folder).groupBy("term").agg(F.sum("tf").alias("tf"))
    none = F.lit(0).cast("bigint")
    counts = terms.agg(F.coalesce(F.sum("tf"), none).alias("n_tokens"), F.count(F.lit(1)).alias("n_terms")).withColumn("n_docs", none)
    docs = _documents(spark, folder).agg(F.count(F.lit(1)).alias("n_docs")).withColumns({"n_tokens": none, "n_terms": none})
    return docs.unionByName(counts).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_terms")])


def builder_must_should(spark: SparkSession, folder: str) -> DataFrame:
    built = BooleanPredicateBuilder.must(["the", "of"]).with_must(BooleanPredicateBuilder.should(["castle", "museum"])).build()
    return _count(boolean.by_pivot(_postings(spark, folder), flatten(built)))


def builder_must_not(spark: SparkSession, folder: str) -> DataFrame:
    built = BooleanPredicateBuilder.must(["the", "of"]).must_not(["castle", "river"]).build()
    return _count(boolean.by_pivot(_postings(spark, folder), flatten(built)))


def builder_with_should(spark: SparkSession, folder: str) -> DataFrame:
    either = BooleanPredicateBuilder.must(["the", "castle"]).with_should(BooleanPredicateBuilder.must(["river", "bridge"])).with_should("museo")
    return _count(boolean.by_pivot(_postings(spark, folder), flatten(either.build())))


def tree_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """node, selectivity, rank, cumulative of a conjunction and of its children, as the planner estimates them."""
    context = BooleanContext(spark)
    context.index_documents("documents", _documents(spark, folder))
    root = context.boolean("documents", "the AND (castle OR river)").plan.estimates
    rows = [("and" if n is root else "or" if n.children else str(n.node), n.selectivity, n.rank, n.cumulative) for n in (root, *root.children)]
    found = spark.createDataFrame(rows, "node string, selectivity double, rank double, cumulative double")
    return found.select("node", *[F.round(c, 6).alias(c) for c in ("selectivity", "rank", "cumulative")])


def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    """lang, n_docs, n_chars of the documents written as JSON lines by language, the folders read by their names."""
    path = scratch_path(spark, "corpus")
    written = _documents(spark, folder).select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("lang", F.lit("none")).alias("lang"))
    written.write.partitionBy("lang").json(path)
    folders = [f"lang={r[0]}" for r in written.select("lang").distinct().collect()]  # a handful of languages
    read = read_paths(spark, path, folders) if folders else spark.createDataFrame([], "id string, text string, path string")
    by_lang = read.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"))
    return by_lang.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


def count_valid(spark: SparkSession, folder: str) -> DataFrame:
    return boolean.count_valid(_documents(spark, folder), "text")


def matching_docs(spark: SparkSession, folder: str) -> DataFrame:
    return boolean.by_pivot(_postings(spark, folder), _tree(NESTED[0]))


def docs_with_tf(spark: SparkSession, folder: str) -> DataFrame:
    p = _postings(spark, folder)
    return boolean.with_frequencies(p, boolean.by_pivot(p, _tree(NESTED[0])), ["the", "und", "nicht", "of"])


def frequency_columns(spark: SparkSession, folder: str) -> DataFrame:
    p = _postings(spark, folder)
    return boolean.frequency_columns(p, boolean.flat_and(p, ["the", "castle"]), ["the", "castle"])


def _batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, BOOLEAN[name][0]) for i, name in enumerate(BATCH)], "query_id bigint, query string")


def query_log_batch(spark: SparkSession, folder: str) -> DataFrame:
    return count_queries(_batch(spark), postings.document_terms(_documents(spark, folder)))


def query_log_counts(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, n: every query of the log on the items."""
    # Sets of documents need no counts, and a batch does not mind repeats.
    held = postings.document_terms(items(table(spark, folder, "wiki_item")), "seq", "text")
    return count_queries(logged_queries(table(spark, folder, "query_log")), held)


def _not_both() -> Node:
    return Or((And((Term("the"), Not(Term("castle")))), And((Not(Term("of")), Not(Or((Term("und"), Term("river"))))))))


def not_by_sets(spark: SparkSession, folder: str) -> DataFrame:
    """n: a tree with negations on both sides of an OR, by joins of sets."""
    ids = _documents(spark, folder).where("doc_id IS NOT NULL").select("doc_id")
    return _count(boolean.by_sets(_postings(spark, folder), simplify(_not_both()), ids))


def pruned_not(spark: SparkSession, folder: str) -> DataFrame:
    tree = simplify(And((Term("nicht"), Not(And((Term("the"), Term("castle")))), Or((Term("museum"), Not(Term("of")))))))
    return _count(boolean.by_pivot(boolean.pruned(_postings(spark, folder), tree), tree))


def stored_index_counts(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, n over an index that was written and loaded again."""
    context = BooleanContext(spark)
    stored = load_or_build(spark, scratch_path(spark, "index"), _documents(spark, folder))
    context.register_index("stored", stored)
    return context.count_all("stored", _batch(spark))


def stored_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(load_or_build(spark, scratch_path(spark, "index"), _documents(spark, folder)).terms)


def json_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, id, n_chars of the documents written as JSON lines in a folder per source, read and numbered again."""
    path = scratch_path(spark, "corpus")
    written = _documents(spark, folder).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "text", "source")
    written.write.partitionBy("source").json(path)
    numbered = number_documents(read_directory(spark, path))
    return numbered.select("doc_id", "id", F.length("text").cast("bigint").alias("n_chars"))


def bitmap_and_ids(spark: SparkSession, folder: str) -> DataFrame:
    return containers.bitmap_ids(boolean.bitmap_and(postings.build_bitmaps(_postings(spark, folder)), ["the", "of", "river"]))


def container_docs(spark: SparkSession, folder: str) -> DataFrame:
    """term, df, first_doc, last_doc of every term, read back from compressed containers."""
    ids = containers.container_postings(containers.build_containers(_postings(spark, folder)))
    return ids.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def matrix_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.pair_counts(dense_matrix(spark, folder), PAIRS)


def term_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return postings.word_length_histogram(_documents(spark, folder))


def candidate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return boolean.candidate_blocks(_postings(spark, folder), _tree("nicht AND (castle OR museum)"))


def pruned_count(spark: SparkSession, folder: str) -> DataFrame:
    tree = _tree("nicht AND (castle OR museum)")
    return _count(boolean.by_pivot(boolean.pruned(_postings(spark, folder), tree), tree))


def rank_order(spark: SparkSession, folder: str) -> DataFrame:
    """position, term, selectivity, rank of the conjuncts as the planner orders them."""
    context = BooleanContext(spark)
    context.index_documents("documents", _documents(spark, folder))
    planned = context.boolean("documents", "the AND castle AND of AND river").plan.estimates
    rows = [(i, str(c.node), c.selectivity, c.rank) for i, c in enumerate(planned.children)]
    found = spark.createDataFrame(rows, "position bigint, term string, selectivity double, rank double")
    return found.select("position", "term", F.round("selectivity", 6).alias("selectivity"), F.round("rank", 6).alias("rank"))


def bitmap_and(spark: SparkSession, folder: str) -> DataFrame:
    return boolean.bitmap_and_count(postings.build_bitmaps(_postings(spark, folder)), ["the", "of", "river"])


def bitmap_or(spark: SparkSession, folder: str) -> DataFrame:
    return boolean.bitmap_or_count(postings.build_bitmaps(_postings(spark, folder)), ["castle", "nicht", "museo"])


def semi_join_and(spark: SparkSession, folder: str) -> DataFrame:
    return _count(boolean.by_sets(_postings(spark, folder), _tree("castle AND river AND the")))


def union_or(spark: SparkSession, folder: str) -> DataFrame:
    return _count(boolean.by_sets(_postings(spark, folder), _tree("castle OR nicht OR museo")))


def forward_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _count(boolean.by_scan(_documents(spark, folder), _tree(NESTED[0])))


def dense_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.dense_matrix(_documents(spark, folder), WORDS)


def _parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    return matrix.vertical_split(dense_matrix(spark, folder), 3)


def split_join(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _parts(spark, folder)
    return matrix.join_split(left, right, "w0", "w3")


def split_join_bitand(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _parts(spark, folder)
    return matrix.join_bitand(left, right, "w0", "w3")


def split_bitand(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.bitand(_parts(spark, folder)[0], "w0", "w1")


def split_bitor(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.bitor(_parts(spark, folder)[0], "w0", "w2")


def corpus_running_total(spark: SparkSession, folder: str) -> DataFrame:
    return postings.corpus_running_total(_documents(spark, folder))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("selectivity", F.round("selectivity", 6))


def _dictionary(p: DataFrame) -> DataFrame:
    return _rounded(postings.dictionary(p))


def p2_key_totals(spark: SparkSession, folder: str) -> DataFrame:
    """term, metas, all_metas, nums, blocks, nums_median, nums_p90: totals and quantiles per term."""
    rows = metas(table(spark, folder, "term_meta_temp"))
    profile = key_profile(rows, "term", "nums_total", sums=["blocks"], quantiles=(0.5, 0.9))
    return profile.select(
        "term",
        F.col("rows").alias("metas"),
        F.col("all_rows").alias("all_metas"),
        F.col("sum_nums_total").alias("nums"),
        F.col("sum_blocks").alias("blocks"),
        F.col("q50").alias("nums_median"),
        F.col("q90").alias("nums_p90"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_key_totals(spark, folder).where("term IS NOT NULL AND metas * 100 >= all_metas").select("term")


def queries() -> dict[str, Query]:
    named = (
        tokenize_stats, builder_must_should, builder_must_not, count_valid, matching_docs, docs_with_tf, frequency_columns,
        query_log_batch, query_log_counts, candidate_blocks, pruned_count, rank_order, bitmap_and, bitmap_or, semi_join_and,
        union_or, forward_scan, dense_matrix, split_join, split_join_bitand, split_bitand, split_bitor, corpus_running_total,
        builder_with_should, tree_estimates, json_paths, not_by_sets, pruned_not, stored_index_counts, stored_dictionary, json_corpus, bitmap_and_ids, container_docs, matrix_pairs,
        term_length_histogram, p2_found, p2_key_totals,
    )
    over = {
        "postings_tf": lambda p: p,
        "posting_by_term": lambda p: p.where(F.col("term") == "castle"),
        "term_dictionary": _dictionary,
        "dictionary_lookup": lambda p: _rounded(postings.lookup(postings.dictionary(p), [*BLOCK_TERMS, "zzqqxx"])),
        "term_blocks": lambda p: postings.lookup(postings.term_blocks(p), BLOCK_TERMS),
        "chunk_encoding_stats": postings.chunk_report,
        "rle_runs": postings.distribution_runs,
        "prefix_terms": lambda p: postings.prefix_terms(_dictionary(p), PREFIX),
        "term_groups": lambda p: postings.term_groups(p.select("term").distinct()),
        "sample_terms": lambda p: postings.sample_terms(p.select("term").distinct()),
    }
    return (
        {name: _boolean(text) for name, (text, _) in BOOLEAN.items()}
        | {f.__name__: f for f in named}
        | {name: _over_postings(operator) for name, operator in over.items()}
    )


_TOKENS = r"""raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM documents),
tok AS (SELECT doc_id, lower(token) AS term FROM raw WHERE octet_length(encode(token)) < 40)"""
_POSTING = f"{_TOKENS}, posting AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id)"
_LOG = r"""item AS (SELECT seq, min(text) AS text FROM wiki_item WHERE seq IS NOT NULL GROUP BY seq),
    raw AS (SELECT seq, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM item),
    posting AS (SELECT DISTINCT seq, lower(token) AS term FROM raw WHERE octet_length(encode(token)) < 40),
    latest AS (SELECT query_id, line FROM query_log WHERE query_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC NULLS LAST, line DESC NULLS LAST) = 1),
    asked AS (SELECT query_id, CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 2) END AS query FROM latest),
    form AS (SELECT DISTINCT query, CASE WHEN contains(query, '(') THEN 'nested' WHEN contains(query, ' OR ') THEN 'any'
        WHEN contains(query, ' AND ') OR starts_with(query, '+') THEN 'all' ELSE 'any' END AS kind FROM asked WHERE query <> ''),
    word AS (SELECT query, kind, unnest(list_filter(regexp_extract_all(query, '\w+'), lambda w: w NOT IN ('AND', 'OR'))) AS w,
        generate_subscripts(list_filter(regexp_extract_all(query, '\w+'), lambda w: w NOT IN ('AND', 'OR')), 1) AS place FROM form),
    wanted AS (SELECT query, kind, lower(w) AS term, min(place) AS place FROM word GROUP BY ALL),
    demand AS (SELECT query, count(*) AS n_terms FROM wanted GROUP BY query),
    met AS (SELECT query, any_value(kind) AS kind, seq, count(*) AS hits, bool_or(place = 1) AS head FROM wanted JOIN posting USING (term) GROUP BY query, seq),
    answer AS (SELECT query, count(*) AS n FROM met JOIN demand USING (query)
        WHERE CASE kind WHEN 'all' THEN hits = n_terms WHEN 'any' THEN true ELSE head AND hits > 1 END GROUP BY query)"""
_META = r"""meta AS (
    SELECT meta_id, min(lower(trim(term, E' \t\n\r\x0b\x0c'))) AS term, any_value(distribution) AS distribution, any_value(nums) AS nums
    FROM term_meta_temp WHERE meta_id IS NOT NULL GROUP BY meta_id)"""
_DICTIONARY = f"""{_POSTING}, term_row AS (
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf, count(DISTINCT doc_id // 512) AS n_blocks,
           round(count(*) / (512.0 * count(DISTINCT doc_id // 512)), 6) AS selectivity
    FROM posting GROUP BY term)"""
_BLOCK = f"{_POSTING}, chunk AS (SELECT term, doc_id // 512 AS block, count(*) AS n_docs FROM posting GROUP BY ALL)"


def _matches(meaning: str) -> str:
    """SELECT of the documents for which a formula over terms in braces holds."""
    terms = sorted(set(re.findall(r"\{([^}]+)\}", meaning)))
    for i, term in enumerate(terms):
        meaning = meaning.replace(f"{{{term}}}", f"t{i}")
    flags = ", ".join(f"bool_or(term = '{t}') AS t{i}" for i, t in enumerate(terms))
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"SELECT doc_id FROM (SELECT doc_id, {flags} FROM tok WHERE term IN ({listed}) GROUP BY doc_id) WHERE {meaning}"


def _counted(meaning: str) -> str:
    return f"WITH {_TOKENS} SELECT count(*) AS n FROM ({_matches(meaning)})"


def _cells(condition: str, columns: str) -> str:
    return f"WITH {_CELLS} SELECT doc_id, {columns} FROM cell WHERE {condition}"


_CELLS = (
    "word AS (SELECT doc_id, upper(unnest(string_split_regex(text, '[ ,.;-]'))) AS w, text FROM documents), cell AS (SELECT d.doc_id, "
    + ", ".join(f"CAST(coalesce(bool_or(w = '{w}'), false) AS TINYINT) AS w{i}" for i, w in enumerate(WORDS))
    + " FROM documents d LEFT JOIN word ON word.doc_id = d.doc_id GROUP BY d.doc_id)"
)


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"'{t}'" for t in BLOCK_TERMS)
    stop_words = ", ".join(f"'{w}'" for w in postings.STOP_WORDS)
    pruned = "{nicht} AND ({castle} OR {museum})"
    batch = " UNION ALL ".join(f"SELECT {i} AS query_id, count(*) AS n FROM ({_matches(BOOLEAN[name][1])})" for i, name in enumerate(BATCH))
    return {name: _counted(meaning) for name, (_, meaning) in BOOLEAN.items()} | {
        "tokenize_stats": f"""WITH {_TOKENS} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_tokens,
            count(DISTINCT term) AS n_terms FROM tok""",
        "builder_must_should": _counted("{the} AND {of} AND ({castle} OR {museum})"),
        "builder_must_not": _counted("{the} AND {of} AND NOT {castle} AND NOT {river}"),
        "builder_with_should": _counted("({the} AND {castle}) OR ({river} AND {bridge}) OR {museo}"),
        "tree_estimates": f"""WITH {_DICTIONARY}, s AS (SELECT
                coalesce(max(CASE WHEN term = 'the' THEN s END), 0) AS t, coalesce(max(CASE WHEN term = 'castle' THEN s END), 0) AS c,
                coalesce(max(CASE WHEN term = 'river' THEN s END), 0) AS r
                FROM (SELECT term, count(*) / (512.0 * count(DISTINCT doc_id // 512)) AS s FROM posting GROUP BY term)),
            e AS (SELECT 'the' AS node, t AS s, 1 AS leaves FROM s UNION ALL SELECT 'or', c + r * (1 - c), 2 FROM s
                UNION ALL SELECT 'and', t * (c + r * (1 - c)), 3 FROM s)
            SELECT node, round(CAST(s AS DOUBLE), 6) AS selectivity, round((CAST(s AS DOUBLE) - 1) / leaves, 6) AS rank,
                round(1 - pow(1 - CAST(s AS DOUBLE), 8), 6) AS cumulative FROM e""",
        "json_paths": """SELECT coalesce(lang, 'none') AS lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
            FROM documents GROUP BY ALL""",
        "count_valid": "SELECT count(text) AS n FROM documents",
        "matching_docs": f"WITH {_TOKENS} {_matches(NESTED[1])}",
        "docs_with_tf": f"""WITH {_POSTING} SELECT doc_id, term, tf FROM posting
            WHERE term IN ('the', 'und', 'nicht', 'of') AND doc_id IN ({_matches(NESTED[1])})""",
        "frequency_columns": f"""WITH {_POSTING} SELECT doc_id, max(CASE WHEN term = 'the' THEN tf END) AS the_freq,
            max(CASE WHEN term = 'castle' THEN tf END) AS castle_freq
            FROM posting WHERE term IN ('the', 'castle') GROUP BY doc_id HAVING count(*) = 2""",
        "query_log_batch": f"WITH {_TOKENS} {batch}",
        "candidate_blocks": f"""WITH {_TOKENS} SELECT block FROM (
            SELECT doc_id // 512 AS block, bool_or(term = 'nicht') AS a, bool_or(term = 'castle') AS b, bool_or(term = 'museum') AS c
            FROM tok GROUP BY ALL) WHERE a AND (b OR c)""",
        "pruned_count": _counted(pruned),
        "rank_order": f"""WITH {_DICTIONARY}, asked AS (
                SELECT term, count(*) / (512.0 * count(DISTINCT doc_id // 512)) AS s FROM posting
                WHERE term IN ('the', 'castle', 'of', 'river') GROUP BY term)
            SELECT row_number() OVER (ORDER BY s) - 1 AS position, term, round(s, 6) AS selectivity, round(s - 1, 6) AS rank FROM asked""",
        "bitmap_and": _counted("{the} AND {of} AND {river}"),
        "bitmap_or": _counted("{castle} OR {nicht} OR {museo}"),
        "semi_join_and": _counted("{castle} AND {river} AND {the}"),
        "union_or": _counted("{castle} OR {nicht} OR {museo}"),
        "forward_scan": _counted(NESTED[1]),
        "dense_matrix": f"WITH {_CELLS} SELECT * FROM cell",
        "split_join": _cells("w0 = 1 AND w3 = 1", "w0, w3"),
        "split_join_bitand": _cells("w0 = 1 AND w3 = 1", "w0, w3"),
        "split_bitand": _cells("w0 = 1 AND w1 = 1", "w0, w1"),
        "split_bitor": _cells("w0 = 1 OR w2 = 1", "w0, w2"),
        "corpus_running_total": """WITH s AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)
            SELECT source, n_docs, CAST(sum(n_docs) OVER (ORDER BY source NULLS FIRST) AS BIGINT) AS running FROM s""",
        "postings_tf": f"WITH {_POSTING} SELECT term, doc_id, tf FROM posting",
        "posting_by_term": f"WITH {_POSTING} SELECT term, doc_id, tf FROM posting WHERE term = 'castle'",
        "term_dictionary": f"WITH {_DICTIONARY} SELECT * FROM term_row",
        "dictionary_lookup": f"WITH {_DICTIONARY} SELECT * FROM term_row WHERE term IN ({listed}, 'zzqqxx')",
        "term_blocks": f"WITH {_BLOCK} SELECT term, block, n_docs FROM chunk WHERE term IN ({listed})",
        "chunk_encoding_stats": f"""WITH {_BLOCK}, e AS (
                SELECT n_docs, CASE WHEN n_docs > 32 OR (n_docs >= 16 AND block = max(block) OVER (PARTITION BY term))
                       THEN 'bitmap' ELSE 'ids' END AS encoding FROM chunk)
            SELECT encoding, count(*) AS n_chunks, CAST(sum(n_docs) AS BIGINT) AS n_postings,
                   CAST(sum(CASE WHEN encoding = 'bitmap' THEN 64 ELSE 2 * n_docs END) AS BIGINT) AS n_bytes
            FROM e GROUP BY encoding""",
        "rle_runs": f"""WITH {_BLOCK}, g AS (
                SELECT term, CASE WHEN block - lag(block) OVER (PARTITION BY term ORDER BY block) = 1 THEN 0 ELSE 1 END AS s FROM chunk)
            SELECT term, CAST(sum(s) AS BIGINT) AS n_runs FROM g GROUP BY term""",
        "prefix_terms": f"WITH {_DICTIONARY} SELECT * FROM term_row WHERE starts_with(term, '{PREFIX}')",
        "term_groups": f"""WITH {_TOKENS}, t AS (SELECT DISTINCT term FROM tok),
            r AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS term_id FROM t)
            SELECT term, term_id, term_id // 100 AS term_group FROM r""",
        "term_length_histogram": f"""WITH {_TOKENS} SELECT CAST(octet_length(encode(token)) AS BIGINT) AS n_bytes, count(*) AS n_words
            FROM raw WHERE token NOT IN ({stop_words}) GROUP BY ALL""",
        "sample_terms": f"WITH {_TOKENS}, t AS (SELECT DISTINCT term FROM tok) SELECT term FROM t ORDER BY md5(term), term LIMIT 100",
        "query_log_counts": f"""WITH {_LOG} SELECT query_id, CASE WHEN query <> '' THEN coalesce(n, 0) END AS n
            FROM asked LEFT JOIN answer USING (query)""",
        "not_by_sets": f"""WITH {_TOKENS}, held AS (SELECT d.doc_id, bool_or(term = 'the') AS a, bool_or(term = 'castle') AS b,
                bool_or(term = 'of') AS c, bool_or(term IN ('und', 'river')) AS e
                FROM documents d LEFT JOIN tok ON tok.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id)
            SELECT count(*) AS n FROM held WHERE (coalesce(a, false) AND NOT coalesce(b, false))
            OR (NOT coalesce(c, false) AND NOT coalesce(e, false))""",
        "pruned_not": _counted("{nicht} AND NOT ({the} AND {castle}) AND ({museum} OR NOT {of})"),
        "stored_index_counts": f"WITH {_TOKENS} {batch}",
        "stored_dictionary": f"WITH {_DICTIONARY} SELECT * FROM term_row",
        "json_corpus": """SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS doc_id, CAST(doc_id AS VARCHAR) AS id,
            length(text) AS n_chars FROM documents WHERE doc_id IS NOT NULL""",
        "bitmap_and_ids": f"WITH {_TOKENS} {_matches('{the} AND {of} AND {river}')}",
        "container_docs": f"""WITH {_POSTING} SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc
            FROM posting GROUP BY term""",
        "matrix_pairs": f"WITH {_CELLS} " + " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = 1 AND {b} = 1) AS n FROM cell" for a, b in PAIRS),
        "p2_found": f"""WITH {_META} SELECT term FROM meta WHERE term IS NOT NULL
            GROUP BY term HAVING count(*) * 100 >= (SELECT count(*) FROM meta)""",
        "p2_key_totals": f"""WITH {_META}, one AS (
                SELECT term, CAST(list_sum(nums) AS BIGINT) AS total,
                       coalesce(list_sum(list_transform(flatten(distribution), lambda w: bit_count(w))), 0) AS blocks
                FROM meta)
            SELECT term, count(*) AS metas, (SELECT count(*) FROM meta) AS all_metas, CAST(sum(total) AS BIGINT) AS nums,
                   CAST(sum(blocks) AS BIGINT) AS blocks, quantile_disc(total, 0.5) AS nums_median, quantile_disc(total, 0.9) AS nums_p90
            FROM one GROUP BY term""",
    }
