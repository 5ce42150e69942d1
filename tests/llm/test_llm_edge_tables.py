import pytest
from conftest import DATA
from edge_tables import write_empty, write_with_nulls
from oracle import connect, same

from termloom.llm import queries, sql


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_empty(spark, f"{DATA}/sf0.001", tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return write_with_nulls(spark, f"{DATA}/sf0.001", tmp_path_factory.mktemp("nulls"))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    rows = queries.queries()[name](spark, empty).collect()
    assert rows == [] or (name == "p8_violations" and not any(rows[0]))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nulls(spark, nulls, name):
    df = queries.queries()[name](spark, nulls)
    if name in ("p1_found", "p5_found", "p5_overlaps"):
        same(df, connect(nulls), sql.oracle_sql()[name])
    else:
        df.collect()
