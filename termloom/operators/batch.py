"""A whole log of queries answered together, on sets of documents by bucket.

Every different query is parsed once, in parallel, into a program over its terms.
The postings of the log's terms are shuffled once, by bucket of documents, however
many queries ask for a term. A task builds the sets of a bucket's terms, lists or
bitmaps, evaluates on them the programs that could match there, and adds up counts
over its buckets, so that no more than a number per query and task is passed on.
No row per query and document exists anywhere.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.errors import QuerySyntaxError
from termloom.operators.containers import BUCKET_BITS, NONE, as_set, both, either, groups, size_of
from termloom.operators.skew import join_unique
from termloom.plans.ast import And, Node, Or, Term, rebuild, simplify
from termloom.plans.parser import parse_query
from termloom.session import materialise

#: Characters of programs answered in one pass, which the tasks get by broadcast; a longer log takes several passes.
LOT_SIZE = 50_000_000
#: Terms of a pass that are broadcast to the postings, likewise bounded by the programs; beyond it they are joined by salted shuffle.
BROADCAST_TERMS = 500_000
SALTS = 16


def compile_query(query: str | None) -> list[str | int] | None:
    """A program in postfix form: a term, ``n`` for the AND of the last n sets, ``-n`` for their OR; None if it cannot be read."""
    try:
        node = simplify(parse_query(query or ""))
    except QuerySyntaxError:
        return None
    program: list[str | int] = []

    def make(current: Node, below: tuple) -> None:
        program.append(current.text if isinstance(current, Term) else len(below) * (1 if isinstance(current, And) else -1))

    rebuild(node, make)
    return program


def _compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        queries = batch.column("query")
        made = [compile_query(q) for q in queries.to_pylist()]
        programs = pa.array([None if m is None else json.dumps(m) for m in made], pa.string())
        yield pa.RecordBatch.from_arrays([queries, programs], ["query", "program"])


def needed_terms(program: list[str | int]) -> list[str]:
    """Terms of which a bucket with a match holds at least one: for an AND those of its least demanding part."""
    waiting: list[list[str]] = []
    for step in program:
        if isinstance(step, str):
            waiting.append([step])
            continue
        parts = [waiting.pop() for _ in range(abs(step))]
        waiting.append(min(parts, key=len) if step > 0 else [t for p in parts for t in p])
    return waiting[0]


def matches(program: list[str | int], sets: dict[str, np.ndarray], bits: int) -> np.ndarray:
    """The set a program comes to, given the sets of the terms that occur."""
    waiting: list[np.ndarray] = []
    for step in program:
        if isinstance(step, str):
            waiting.append(sets.get(step, NONE))
            continue
        parts = waiting[-abs(step) :]
        del waiting[-abs(step) :]
        waiting.append(both(parts) if step > 0 else either(parts, bits))
    return waiting[0]


def _answer(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, programs = shared.value
        asked_for: dict[str, list[int]] = defaultdict(list)
        programs = [json.loads(p) for p in programs]
        for i, program in enumerate(programs):
            for term in needed_terms(program):
                asked_for[term].append(i)
        counts, current, sets = np.zeros(len(programs), np.int64), None, {}

        def settle() -> None:
            for i in {i for term in sets for i in asked_for.get(term, ())}:
                counts[i] += size_of(matches(programs[i], sets, bits))
            sets.clear()

        for (bucket, term), offsets in groups(batches, ["bucket", "term"], "offset"):
            if bucket != current:
                settle()
                current = bucket
            sets[term] = as_set(np.unique(offsets), bits)
        settle()
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(numbers, np.int64)[found]), pa.array(counts[found])], ["q", "n"])

    return run


def _of_vocabulary(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of some terms."""
    rows = postings.select("term", "doc_id").where("doc_id >= 0")
    wanted = postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    if len(terms) <= BROADCAST_TERMS:
        return rows.join(F.broadcast(wanted), "term", "left_semi")
    # A term in every document is dealt over as many tasks as any other.
    dealt = rows.withColumn("_salt", F.pmod("doc_id", F.lit(SALTS)))
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return dealt.join(salted, ["term", "_salt"], "left_semi").drop("_salt")


def count_queries(queries: DataFrame, postings: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """``query_id, n``: matching documents of every query of ``query_id, query``.

    A query that cannot be read, a null one too, has a null ``n``; one without
    matches has 0. Repeated ``query_id``s stay repeated. However often a query is
    asked, it is answered once. Documents are numbered from 0; postings of other
    documents and repeated postings are left out.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("query").cast("string").alias("query"))
    different = asked.where("query IS NOT NULL").select("query").distinct()
    plans = materialise(
        different.mapInArrow(_compiled, "query string, program string").withColumn("q", F.monotonically_increasing_id()), "plans"
    )
    readable = plans.where("program IS NOT NULL")
    size = readable.agg(F.sum(F.length("program")), F.sum(F.octet_length("query") + 16)).first()
    lots = -(-(size[0] or 0) // LOT_SIZE)
    answers = []
    for lot in range(lots):
        mine = readable.where(F.pmod(F.xxhash64("query"), F.lit(lots)) == lot) if lots > 1 else readable
        # Bounded by LOT_SIZE, and so are the terms.
        rows = mine.select("q", "program").collect()
        terms = sorted({t for r in rows for t in json.loads(r["program"]) if isinstance(t, str)})
        shared = spark.sparkContext.broadcast(([r["q"] for r in rows], [r["program"] for r in rows]))
        placed = _of_vocabulary(postings, terms).select(
            F.shiftright("doc_id", bits).alias("bucket"), "term", F.pmod("doc_id", F.lit(1 << bits)).cast("int").alias("offset")
        )
        arranged = placed.repartition("bucket").sortWithinPartitions("bucket", "term")
        answers.append(arranged.mapInArrow(_answer(shared, bits), "q bigint, n bigint"))
    none = spark.createDataFrame([], "q bigint, n bigint")
    counts = reduce(DataFrame.unionByName, answers, none).groupBy("q").agg(F.sum("n").alias("n"))
    answered = readable.select("q", "query").join(counts, "q", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))
    return join_unique(asked, answered, "query", size=size[1] or 0).select("query_id", "n")
