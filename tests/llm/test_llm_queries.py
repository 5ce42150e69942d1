import pytest
from conftest import DATA
from oracle import connect, same

from termloom.llm import queries, sql

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(queries.queries()[name](spark, FOLDER), con, sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, name):
    # The smallest tables hold no look-alike texts.
    assert queries.queries()[name](spark, f"{DATA}/sf0.01").count() > 0


def test_split_documents_are_those_with_more_tokens_than_a_container(spark):
    ids = {r.doc_id: len(r.ids) for r in queries.p7_ids(spark, FOLDER).collect()}
    assert len(ids) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert {r.doc_id for r in queries.p8_found(spark, FOLDER).collect()} == {d for d, n in ids.items() if n > 2048}
