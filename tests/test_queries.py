import pytest

from postmill.catalogue import ORACLE, QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf, con):
    assert differences(QUERIES[name](spark, sf), ORACLE[name], con) == []


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(QUERIES) - set(ORACLE) == {"docs_or_dedup"}


def test_entry(spark):
    import __spark_entry__

    rows = {r.filter_reason: r.n for r in __spark_entry__.entry(spark).collect()}
    assert sum(rows.values()) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_the_library_stands_alone():
    from pathlib import Path

    root = Path(__file__).parent.parent / "postmill"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "postmill.llm" not in path.read_text(encoding="utf-8"), path
