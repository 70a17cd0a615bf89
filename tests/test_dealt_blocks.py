"""Whole checks over block tables that are written dealt by document."""

import re

import pytest

import __spark_entry__
from quillcheck.operators import objects, violations
from quillcheck.sources import staging

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["whole_check", "two_profiles_check"])
def test_blocks_are_not_shuffled_again(spark, monkeypatch, query):
    monkeypatch.setattr(staging, "TASK_ROWS", 1000)
    before = {t.name for t in spark.catalog.listTables()}
    plan = __spark_entry__.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert not re.findall(r"Exchange hashpartitioning\([^)]*doc_id", plan)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_references_and_captions_without_document_or_number_stay_apart(spark):
    captions = spark.createDataFrame([(1, "1", 5), (1, "1", 7), (1, "2", 1), (1, "4", 2), (None, "1", 3)], "doc_id int, number string, para_ix int")
    references = spark.createDataFrame([(1, "1", 6), (1, "2", 4), (1, "3", 8), (None, "1", 9)], "doc_id int, number string, ref_ix int")
    found = lambda unreferenced: sorted(tuple(map(str, r)) for r in objects.reference_faults(references, captions, "x", unreferenced).select("doc_id", "para_ix", "actual").collect())
    referred = [("1", "1", "2: before its first reference"), ("1", "None", "3: caption missing"), ("None", "None", "1: caption missing")]
    assert found(False) == sorted(referred)
    assert found(True) == sorted([*referred, ("1", "2", "4: never referred to"), ("None", "3", "1: never referred to")])


def test_findings_of_hidden_places_go(spark):
    none = {c: None for c in violations.COLUMNS}
    kinds = ", ".join(f"{c} {'int' if c == 'doc_id' or c.endswith('_index') else 'string'}" for c in violations.COLUMNS)
    made = [{**none, "doc_id": d, "paragraph_index": p, "table_index": t, "parameter": x} for d, p, t, x in [(1, 2, None, "a"), (1, 2, None, "required_document_structure"), (1, 3, None, "a"), (1, None, 4, "a"), (1, None, 5, "a"), (1, None, None, "a"), (None, 2, None, "a"), (2, 2, 4, "a")]]
    paragraphs = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (1, None)], "doc_id int, para_ix int")
    tables = spark.createDataFrame([(1, 4), (1, None)], "doc_id int, table_ix int")
    kept = violations.without_places(spark.createDataFrame([tuple(m[c] for c in violations.COLUMNS) for m in made], kinds), paragraphs, tables)
    assert sorted(map(str, (tuple(r) for r in kept.select("doc_id", "paragraph_index", "table_index", "parameter").collect()))) == sorted(map(str, [(1, 2, None, "required_document_structure"), (1, 3, None, "a"), (1, None, 5, "a"), (1, None, None, "a"), (None, 2, None, "a"), (2, 2, 4, "a")]))
