"""Every query with SQL agrees with DuckDB; every other one runs."""

import pytest

from tests.helpers import same, views
from weftline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck, registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_markdown_lines_are_whole(spark):
    """Each line of the documents ends its escaped line."""
    lines = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (pos, line)")
    found = registry.queries()["md_escape_lines"](spark, SF)
    assert found.count() == lines.count() and found.join(lines, ["doc_id", "pos"]).where("NOT endswith(escaped, line)").count() == 0
    assert found.where("length(escaped) > 60").count() > 0
