import pytest
from conftest import DATA
from edge_tables import write_empty, write_with_nulls

from termloom import queries as core

COUNTS = {*core.BOOLEAN, "tokenize_stats", "builder_must_should", "builder_must_not", "count_valid", "pruned_count", "bitmap_and", "bitmap_or", "semi_join_and", "union_or", "forward_scan", "not_by_sets", "pruned_not", "builder_with_should"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_empty(spark, f"{DATA}/sf0.001", tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return write_with_nulls(spark, f"{DATA}/sf0.001", tmp_path_factory.mktemp("nulls"))


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_empty_tables(spark, empty, name):
    rows = core.queries()[name](spark, empty).collect()
    if name in COUNTS:
        assert len(rows) == 1 and not any(rows[0])
    elif name in ("query_log_batch", "stored_index_counts", "matrix_pairs"):
        assert all(r.n == 0 for r in rows)
    elif name == "tree_estimates":
        assert [r.selectivity for r in rows] == [0.0]
    else:
        assert rows == []


@pytest.mark.parametrize("name", ["p2_found", "p2_key_totals", "query_log_counts", "postings_tf", "term_dictionary", "dense_matrix", "nested_and_or"])
def test_nulls(spark, nulls, name):
    core.queries()[name](spark, nulls).collect()
