"""Whole checks against their SQL over documents of which some have no text at all."""

import duckdb
import pytest

from quillcheck import composed_profiles, registry  # noqa: F401

#: (order, line, part, supplier); three orders make a document. Part 6 is an empty paragraph, 12 and 24 are headings, 8 is main text.
LINES = [(0, 1, 6, 1), (1, 1, 18, 2), (3, 1, 12, 6), (3, 2, 6, 3), (4, 1, 8, 2), (6, 1, 24, 6), (7, 1, 12, 5), (9, 2, 30, 4)]


@pytest.mark.parametrize("name", ["whole_check", "two_profiles_check"])
def test_documents_without_text(spark, tmp_path, name):
    values = ", ".join(f"({o}, {n}, {p}, {s})" for o, n, p, s in LINES)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(p AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey, CAST(n AS INTEGER) AS l_linenumber, 10.0::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax, 'N' AS l_returnflag, 'F' AS l_linestatus FROM (VALUES {values}) v(o, n, p, s)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    assert got == want
    at, doc = columns.index("parameter"), columns.index("doc_id")
    assert {r[doc] for r in got if r[at] == "required_document_structure"} == {1}
