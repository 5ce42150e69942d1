"""The entry point of a session: registered indexes and boolean queries over them."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from termloom.errors import UnknownIndexError
from termloom.operators import boolean
from termloom.operators.batch import count_queries
from termloom.operators.postings import lookup
from termloom.plans.ast import Node, terms_of
from termloom.plans.builder import BooleanPredicateBuilder
from termloom.plans.parser import parse_query
from termloom.plans.planner import Plan, TermStats, plan
from termloom.session import ship
from termloom.sources.index_store import Index, build_index, load_index

Query = str | Node | BooleanPredicateBuilder
#: Terms of an index whose statistics a context remembers.
REMEMBERED_TERMS = 100_000


@dataclass(frozen=True)
class BooleanQuery:
    """A planned query. Nothing runs until a result is asked for."""

    index: Index
    plan: Plan

    def docs(self) -> DataFrame:
        """``doc_id`` of the matching documents."""
        return boolean.run(self.plan, self.index.postings, self.index.documents)

    def count_agg(self) -> DataFrame:
        """``n``: how many documents match, as a table of one row."""
        return self.docs().agg(F.count(F.lit(1)).alias("n"))

    def count(self) -> int:
        """How many documents match; no job runs for a query that cannot match."""
        return 0 if self.plan.strategy == "empty" else self.count_agg().first()["n"]

    def docs_with_tf(self) -> DataFrame:
        """``doc_id, term, tf`` of the query's terms in the matching documents."""
        return boolean.with_frequencies(self.index.postings, self.docs(), self.plan.terms)

    def collect(self) -> list[Row]:
        return self.count_agg().collect()

    def show(self, n: int = 20) -> None:
        self.docs().show(n)

    def explain(self, mode: str = "formatted", analyze: bool = False) -> str:
        """The query's plan and, printed by Spark, the physical plan.

        With ``analyze`` the query is run first: the plan is the one that ran, and the
        count and the seconds it took come with it.
        """
        counted = self.count_agg()
        ran = ""
        if analyze:
            began = time.perf_counter()
            n = counted.collect()[0]["n"]
            ran = f"\nmatches: {n}\nseconds: {time.perf_counter() - began:.3f}"
        counted.explain(mode)
        return self.plan.explain() + ran


class BooleanContext:
    """Indexes by name, and queries over them."""

    def __init__(self, spark: SparkSession):
        self.spark = ship(spark)
        self.session_id = spark.sparkContext.applicationId
        self.session_start_time = datetime.now(timezone.utc)
        self._indexes: dict[str, Index] = {}
        self._stats: dict[str, dict[str, TermStats | None]] = {}

    @classmethod
    def with_state(cls, spark: SparkSession) -> BooleanContext:
        """A context on a session that exists."""
        return cls(spark)

    @classmethod
    def with_config(cls, config: dict[str, str]) -> BooleanContext:
        """A context on a session with these settings."""
        return cls(SparkSession.builder.config(map=config).getOrCreate())

    def register_index(self, name: str, index: Index | str) -> Index:
        """Register an index, or the one written at a path; its tables become the views ``<name>_postings`` and so on."""
        if isinstance(index, str):
            found = load_index(self.spark, index)
            if found is None:
                raise UnknownIndexError(f"no whole index at {index}")
            index = found
        for table in ("postings", "terms", "documents"):
            getattr(index, table).createOrReplaceTempView(f"{name}_{table}")
        self._indexes[name] = index
        self._stats[name] = {}
        return index

    def index_documents(self, name: str, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """Build and register an index of documents, without writing it."""
        return self.register_index(name, build_index(documents, doc_id, text))

    def index_provider(self, name: str) -> Index:
        """The registered index; another name for ``index``."""
        return self.index(name)

    def index(self, name: str) -> Index:
        if name not in self._indexes:
            raise UnknownIndexError(name)
        return self._indexes[name]

    def stats(self, name: str, terms: list[str]) -> dict[str, TermStats]:
        """Statistics of those terms that exist; the dictionary is asked once for each term."""
        index, known = self.index(name), self._stats[name]
        if len(known) > REMEMBERED_TERMS:
            known.clear()
        if new := [t for t in terms if t not in known]:
            rows = lookup(index.terms, new).select("term", "df", "selectivity").collect()
            found = {r["term"]: TermStats(r["df"], r["selectivity"]) for r in rows}
            known.update((t, found.get(t)) for t in new)
        return {t: known[t] for t in terms if known[t] is not None}

    def boolean(self, name: str, query: Query, use_stats: bool = True) -> BooleanQuery:
        """Plan a query: text in either language, a tree, or a builder.

        With ``use_stats`` the dictionary is asked first: missing terms are folded
        and conjuncts ordered by rank.
        """
        node = parse_query(query) if isinstance(query, str) else query.build() if isinstance(query, BooleanPredicateBuilder) else query
        stats = self.stats(name, terms_of(node)) if use_stats else None
        return BooleanQuery(self.index(name), plan(node, stats))

    def count(self, name: str, query: Query) -> int:
        return self.boolean(name, query).count()

    def count_all(self, name: str, queries: DataFrame) -> DataFrame:
        """``query_id, n`` for a whole table ``query_id, query`` in one job."""
        return count_queries(queries, self.index(name).postings)
