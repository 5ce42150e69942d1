import pytest
from conftest import DATA
from oracle import connect, same

from termloom import queries as core

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(core.queries()[name](spark, FOLDER), con, core.oracle_sql()[name])


def test_every_query_has_an_sql_twin():
    assert set(core.queries()) == set(core.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_llm_package():
    import pathlib

    package = pathlib.Path(core.__file__).parent
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert "termloom.llm" not in path.read_text(), path
