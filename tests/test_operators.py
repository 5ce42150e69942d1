import os
import random

import pytest

from termloom import session
from termloom.context import BooleanContext
from termloom.errors import UnknownIndexError
from termloom.functions.analysis import query_tokens
from termloom.operators import batch, boolean, containers, matrix, postings, skew
from termloom.operators.batch import compile_query, count_queries, needed_terms
from termloom.operators.ranking import global_rank
from termloom.plans.ast import And, Not, Or, Term, holds, simplify
from termloom.plans.builder import BooleanPredicateBuilder
from termloom.plans.parser import parse_query
from termloom.sources.index_store import Index, build_index, load_index, load_or_build, save_index

LISTS = {"a": [1, 2, 6, 8, 15], "b": [0, 4, 9, 13, 17], "c": [3, 7, 11, 17, 19], "d": [6, 7, 9, 14, 18]}
COUNTS = {
    "a AND d": 1, "b AND c": 1, "c AND d": 1, "b AND d": 1, "a OR b": 10, "a OR d": 9, "a AND b": 0, "(a OR b) AND d": 2,
    "a OR (b AND c)": 6, "a AND (b OR c)": 0, "a AND missing": 0, "a OR missing": 5, "a": 5, "a AND a": 5,
}


@pytest.fixture(scope="module")
def lists(spark):
    rows = [(t, d, 1) for t, ids in LISTS.items() for d in ids]
    return spark.createDataFrame(rows, "term string, doc_id bigint, tf bigint")


@pytest.fixture(scope="module")
def index(spark, lists):
    return Index(lists, postings.dictionary(lists), spark.range(20).withColumnRenamed("id", "doc_id"))


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize(("text", "n"), COUNTS.items())
def test_counts(spark, index, text, n):
    context = BooleanContext(spark)
    context.register_index("t", index)
    assert context.count("t", text) == n
    assert context.boolean("t", text, use_stats=False).count() == n


def test_strategies_agree_with_sets(spark, index, lists):
    bitmaps = postings.build_bitmaps(lists)
    texts = [(d, " ".join(t for t in LISTS if d in LISTS[t])) for d in range(20)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    rng = random.Random(3)
    for _ in range(6):
        tree = simplify(And((Term(rng.choice("abcd")), Or((Term(rng.choice("abcd")), And((Term(rng.choice("abcd")), Term(rng.choice("abcd")))))))))
        expected = [d for d in range(20) if holds(tree, {t for t in LISTS if d in LISTS[t]})]
        for matches in (boolean.by_pivot(lists, tree), boolean.by_sets(lists, tree), boolean.by_scan(documents, tree)):
            assert ids(matches) == expected
        assert ids(boolean.by_pivot(boolean.pruned(lists, tree, 4), tree)) == expected
    assert ids(boolean.flat_and(lists, ["b", "d", "b"])) == [9]
    assert ids(boolean.flat_or(lists, ["a", "zz"])) == LISTS["a"]
    assert boolean.bitmap_and_count(bitmaps, ["b", "d"]).first()[0] == 1
    assert boolean.bitmap_and_count(bitmaps, ["b", "zz"]).first()[0] == 0
    assert boolean.bitmap_or_count(bitmaps, ["a", "b"]).first()[0] == 10


def test_not(spark, index, lists):
    tree = BooleanPredicateBuilder.should(["a", "b"]).must_not(["d"]).build()
    expected = sorted({*LISTS["a"], *LISTS["b"]} - {*LISTS["d"]})
    assert ids(boolean.by_pivot(lists, tree)) == expected == ids(boolean.by_sets(lists, tree))
    alone = Not(Or((Term("a"), Term("b"))))
    assert ids(boolean.by_pivot(lists, alone, index.documents)) == sorted(set(range(20)) - {*LISTS["a"], *LISTS["b"]})
    with pytest.raises(ValueError, match="documents"):
        boolean.by_pivot(lists, alone)


def test_context(spark, index, capsys):
    context = BooleanContext(spark)
    context.register_index("t", index)
    with pytest.raises(UnknownIndexError):
        context.index("other")
    query = context.boolean("t", BooleanPredicateBuilder.must(["b", "d"]))
    assert query.collect()[0]["n"] == 1
    assert [tuple(r) for r in query.docs_with_tf().orderBy("term").collect()] == [(9, "b", 1), (9, "d", 1)]
    assert "strategy: all" in query.explain()
    assert "matches: 1\n" in query.explain(analyze=True)
    assert BooleanContext.with_state(spark).session_id == context.session_id and context.index_provider("t") is index
    query.show()
    assert "HashAggregate" in capsys.readouterr().out
    assert spark.table("t_postings").count() == 20
    assert set(context.stats("t", ["a", "missing"])) == set(context.stats("t", ["missing", "a"])) == {"a"}
    assert BooleanContext.with_config({"spark.sql.shuffle.partitions": "4"}).session_id == context.session_id
    empty = context.boolean("t", "a AND missing")
    assert empty.plan.strategy == "empty" and empty.docs().count() == 0


def test_not_by_sets_against_brute_force(spark, lists, index):
    rng = random.Random(12)

    def grow(depth):
        kind = rng.choice([Term, Not, And, Or]) if depth else Term
        if kind is Term:
            return Term(rng.choice("abcd"))
        return Not(grow(depth - 1)) if kind is Not else kind((grow(depth - 1), grow(depth - 1)))

    trees = [grow(3) for _ in range(12)] + [Or((Term("b"), Not(Term("a")))), Not(Term("a")), And((Not(Term("a")), Not(Term("b"))))]
    for tree in trees:
        expected = [d for d in range(20) if holds(tree, {t for t in LISTS if d in LISTS[t]})]
        assert ids(boolean.by_sets(lists, tree, index.documents).distinct()) == expected, tree
        assert ids(boolean.by_pivot(boolean.pruned(lists, tree, 4), tree, index.documents)) == expected, tree
    with pytest.raises(ValueError, match="documents"):
        boolean.by_sets(lists, Not(Term("a")))
    with pytest.raises(ValueError, match="block"):
        boolean.candidate_blocks(lists, Or((Term("b"), Not(Term("a")))))


def test_not_in_blocks_that_hold_the_term(spark):
    p = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 600, 1), ("c", 3, 1)], "term string, doc_id bigint, tf bigint")
    documents = spark.createDataFrame([(1,), (2,), (3,), (600,)], "doc_id bigint")
    tree = And((Term("a"), Not(Term("b"))))
    assert ids(boolean.by_pivot(boolean.pruned(p, tree), tree)) == [2]
    assert ids(boolean.candidate_blocks(p, tree)) == [0]
    assert ids(boolean.by_sets(p, Or((Term("b"), Not(Term("a")))), documents)) == [1, 3, 600]


def test_repeated_postings(spark):
    p = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("b", 2, 1), ("b", 2, 1)], "term string, doc_id bigint, tf bigint")
    assert ids(boolean.flat_and(p, ["a", "b"])) == [2]
    many = [f"t{i}" for i in range(130)]
    wide = spark.createDataFrame([(t, d, 1) for t in many for d in (1, 2) if (t, d) != ("t129", 2)], "term string, doc_id bigint, tf bigint")
    assert ids(boolean.flat_and(wide, many)) == [1] and ids(boolean.flat_and(wide, many[:129])) == [1, 2]
    asked = spark.createDataFrame([(1, "a AND b"), (2, "a OR b")], "query_id bigint, query string")
    assert {r.query_id: r.n for r in count_queries(asked, p).collect()} == {1: 1, 2: 2}


def test_containers(spark):
    rng = random.Random(2)
    sets = {"one": {5}, "run": set(range(100, 9000)), "dense": set(rng.sample(range(40_000), 20_000)), "sparse": set(rng.sample(range(10**6), 300)), "all": set(range(1 << 14))}
    rows = [(t, d) for t, s in sets.items() for d in s] + [("one", 5), (None, 3), ("one", None)]
    held = containers.build_containers(spark.createDataFrame(rows, "term string, doc_id bigint").repartition(5))
    kinds = {r.term: r.encoding for r in held.where("bucket = 0").collect()}
    assert kinds["dense"] == "bitmap" and kinds["run"] == "runs" == kinds["all"] and kinds["one"] == "ids"
    found = {}
    for r in containers.container_postings(held).collect():
        found.setdefault(r.term, []).append(r.doc_id)
    assert {t: sorted(d) for t, d in found.items()} == {t: sorted(s) for t, s in sets.items()}
    assert max(len(r.data) for r in held.collect()) <= 2048 and held.where("term = 'one'").first().n_docs == 1
    p = spark.createDataFrame([("a", 3, 1), ("a", 70_000, 1), ("b", 70_000, 1)], "term string, doc_id bigint, tf bigint")
    bitmaps = postings.build_bitmaps(p)
    assert ids(containers.bitmap_ids(boolean.bitmap_and(bitmaps, ["a"]))) == [3, 70_000]
    assert ids(containers.bitmap_ids(boolean.bitmap_and(bitmaps, ["a", "b"]))) == [70_000]


def test_query_batch_over_buckets_and_lots(spark, monkeypatch):
    rng = random.Random(9)
    lists = {t: sorted(rng.sample(range(60_000), n)) for t, n in (("a", 30_000), ("b", 20_000), ("c", 500), ("d", 40))}
    p = spark.createDataFrame([(t, d, 1) for t, x in lists.items() for d in x], "term string, doc_id bigint, tf bigint")
    texts = ["a", "d", "a AND b", "a OR b", "c AND d", "c OR d", "a AND (c OR d)", "c OR (a AND b)", "(a AND c) OR (b AND d)", "a AND zz", "c OR zz"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
    held = {t: set(x) for t, x in lists.items()}
    wanted = {}
    for i, text in enumerate(texts):
        tree = parse_query(text)
        wanted[i] = sum(holds(tree, {t for t in held if d in held[t]}) for d in set().union(*held.values()))
    assert {r.query_id: r.n for r in count_queries(asked, p).collect()} == wanted
    for name, value in (("LOT_SIZE", 60), ("BROADCAST_TERMS", 0)):
        monkeypatch.setattr(batch, name, value)
    monkeypatch.setattr(batch, "join_unique", lambda *a, size: skew.join_unique(*a, limit=0))
    assert {r.query_id: r.n for r in count_queries(asked, p, 10).collect()} == wanted


def test_join_unique(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(200)] + [("x", 1), (None, 2), ("none", 3)], "k string, v bigint")
    table = spark.createDataFrame([("hot", 10), ("x", 20), (None, 30), ("unused", 40)], "k string, w bigint")
    for limit in (10**6, 0):
        for how, extra in (("left", [("none", 3, None)]), ("inner", [])):
            found = sorted(map(tuple, skew.join_unique(rows, table, "k", how, limit).collect()), key=repr)
            assert found == sorted([*(("hot", i, 10) for i in range(200)), ("x", 1, 20), (None, 2, 30), *extra], key=repr)


def test_word_lengths(spark):
    documents = spark.createDataFrame([("the The château a",), ("chateau the",), (None,)], "text string")
    assert {r.n_bytes: r.n_words for r in postings.word_length_histogram(documents).collect()} == {3: 1, 8: 1, 7: 1}
    assert {r.n_bytes: r.n_words for r in postings.word_length_histogram(documents, stop_words=()).collect()} == {1: 1, 3: 3, 8: 1, 7: 1}


def test_vowel_signs_belong_to_their_words(spark):
    documents = spark.createDataFrame([(1, "हिन्दी में ⓐb")], "doc_id bigint, text string")
    assert {r.term for r in postings.build_postings(documents).collect()} == {"हिन", "दी", "में", "ⓐb"} == set(query_tokens("हिन्दी में ⓐb"))


def test_pair_counts(spark):
    m = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 1), (3, 0, 1, 1)], "doc_id bigint, w0 tinyint, w1 tinyint, w2 tinyint")
    assert sorted(map(tuple, matrix.pair_counts(m, [("w0", "w1"), ("w0", "w2"), ("w1", "w1")]).collect())) == [("w0", "w1", 2), ("w0", "w2", 1), ("w1", "w1", 3)]
    assert [r.n for r in matrix.pair_counts(m.limit(0), [("w0", "w1")]).collect()] == [0]


def test_candidate_blocks(lists):
    tree = simplify(parse_query("(a OR b) AND c"))
    assert ids(boolean.candidate_blocks(lists, tree, 10)) == [0, 1]
    assert ids(boolean.candidate_blocks(lists, simplify(parse_query("a AND c")), 5)) == [0, 1, 3]


def test_blocks_beyond_the_first_and_bitmap_threshold(spark):
    rows = [("x", 0), ("x", 40000), *[("y", i) for i in range(32)], *[("y", i) for i in range(512, 545)], *[("z", i) for i in range(16)]]
    p = spark.createDataFrame([(t, d, 1) for t, d in rows], "term string, doc_id bigint, tf bigint")
    assert boolean.flat_or(p, ["x"]).count() == 2
    assert boolean.bitmap_or_count(postings.build_bitmaps(p), ["x"]).first()[0] == 2
    kinds = {(r.term, r.block): (r.encoding, r.n_bytes) for r in postings.chunks(p).collect()}
    assert kinds == {("x", 0): ("ids", 2), ("x", 78): ("ids", 2), ("y", 0): ("ids", 64), ("y", 1): ("bitmap", 64), ("z", 0): ("bitmap", 64)}
    assert {r.term: r.n_runs for r in postings.distribution_runs(p).collect()} == {"x": 2, "y": 1, "z": 1}


def test_frequencies_beyond_a_byte(spark):
    documents = spark.createDataFrame([(512, "w " * 9), (513, "w " * 300), (514, None), (515, ""), (None, "w")], "doc_id bigint, text string")
    found = {r.doc_id: r.tf for r in postings.build_postings(documents).collect()}
    assert found == {512: 9, 513: 300}


def test_analyzer(spark):
    text = f"Naïve_café-10.5 Ünï {'x' * 39} {'y' * 40} {'é' * 20} ΣΑΣ ½"
    documents = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert {r.term for r in postings.build_postings(documents).collect()} == {"naïve", "café", "10", "5", "ünï", "x" * 39, "σας", "½"}


def test_dictionary(spark, lists):
    rows = {r.term: (r.df, r.ctf, r.n_blocks, r.selectivity) for r in postings.dictionary(lists, 10).collect()}
    assert rows["a"] == (5, 5, 2, 0.25)
    assert sorted(r.term for r in postings.prefix_terms(spark.createDataFrame([("123",), ("12567896",), ("12587899",)], "term string"), "125").collect()) == ["12567896", "12587899"]
    grouped = postings.term_groups(lists.select("term").distinct(), 2).orderBy("term_id").collect()
    assert [(r.term, r.term_id, r.term_group) for r in grouped] == [("a", 0, 0), ("b", 1, 0), ("c", 2, 1), ("d", 3, 1)]
    assert postings.sample_terms(lists.select("term").distinct(), 3).collect() == postings.sample_terms(lists.select("term").distinct(), 3).collect()


def test_matrix(spark):
    rows = [(1, "abc"), (2, "bcd"), (3, "cde,x"), (4, "Abc;abc"), (5, "cde"), (6, None)]
    m = matrix.dense_matrix(spark.createDataFrame(rows, "doc_id bigint, text string"), ["ABC", "BCD", "CDE"])
    cells = {r.doc_id: (r.w0, r.w1, r.w2) for r in m.collect()}
    assert cells == {1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1), 4: (1, 0, 0), 5: (0, 0, 1), 6: (0, 0, 0)}
    left, right = matrix.vertical_split(m, 2)
    assert (left.columns, right.columns) == (["doc_id", "w0", "w1"], ["doc_id", "w2"])
    assert matrix.join_split(left, right, "w0", "w2").count() == 0 == matrix.join_bitand(left, right, "w0", "w2").count()
    assert sorted(r.doc_id for r in matrix.bitor(left, "w0", "w1").collect()) == [1, 2, 4]
    assert matrix.bitand(left, "w0", "w1").count() == 0


def test_query_batch(spark, lists):
    wide = " OR ".join([f"q{i}" for i in range(70)] + ["a"])
    exploding = " AND ".join(f"(a OR b OR x{i})" for i in range(6))
    texts = [*COUNTS, "a b", "+a +d", None, "", "( a", "___", wide, exploding]
    expected = [*COUNTS.values(), 10, 1, None, None, None, None, 5, 10]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string").unionByName(
        spark.createDataFrame([(99, "a")], "query_id bigint, query string")
    )
    found = {r.query_id: r.n for r in count_queries(asked, lists).collect()}
    assert [found[i] for i in range(len(texts))] == expected
    assert found[99] == 5
    assert compile_query("+a +(b c)") == ["a", "b", "c", -2, 2]
    assert needed_terms(["a", "b", "c", -2, 2]) == ["a"] and sorted(needed_terms(["a", "b", 2, "c", -2])) in (["a", "c"], ["b", "c"])
    assert count_queries(asked.limit(0), lists).count() == 0


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS v", "id AS _part2")
    ranked = global_rank(df, ["v"], "n").collect()
    assert all(r.v == r.n for r in ranked) and len(ranked) == 1000


def test_index_store(spark, tmp_path):
    documents = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, None)], "doc_id bigint, text string")
    path = str(tmp_path / "index")
    assert load_index(spark, path) is None
    index = load_or_build(spark, path, documents)
    assert index.documents.count() == 3
    assert [r.term for r in index.terms.orderBy("term").collect()] == ["dog", "fox", "red"]
    plan = index.postings.where("term = 'red'")._jdf.queryExecution().toString()
    assert "EqualTo(term,red)" in plan
    (tmp_path / "index" / "terms" / "_SUCCESS").unlink()
    assert load_index(spark, path) is None
    save_index(build_index(documents), path, "overwrite")
    assert load_index(spark, path) is not None
    context = BooleanContext(spark)
    context.register_index("stored", path)
    assert context.count("stored", "red AND fox") == 1
    with pytest.raises(UnknownIndexError):
        context.register_index("none", str(tmp_path / "none"))


def test_intermediate_tables_go_with_their_block(spark):
    before = session.materialise(spark.range(3), "kept")
    with session.discarding():
        inside = session.materialise(spark.range(3), "gone")
        files = [f.removeprefix("file://") for f in inside.inputFiles()]
        assert files and all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files)
    assert before.count() == 3


def test_few_files_are_spread_but_shuffled_rows_are_not(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shuffled = one.groupBy("id").count()
    assert session.spread(shuffled) is shuffled
