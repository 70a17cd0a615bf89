"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

from pathlib import Path

import duckdb
import pytest

from quillcheck import composed, composed_plans, composed_profiles, composed_reports, composed_rules, composed_tables, composed_text, queries, registry  # noqa: F401

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return order, sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, str(SF))
    found = tables.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, str(SF)).columns


def test_flagship(spark):
    assert queries.flagship(spark, str(SF)).count() > 0
