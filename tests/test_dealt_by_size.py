import re

import pytest

import __spark_entry__
from quillcheck.operators import documents, violations
from quillcheck.sources import staging
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def shuffles_by_document(df):
    """Partitions of each shuffle by document in the plan."""
    return {int(n) for n in re.findall(r"Exchange hashpartitioning\((?:doc_id|l_orderkey|o_orderkey)#[^()]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


@pytest.mark.parametrize("query", ["consistency_findings", "margin_findings", "comment_groups", "run_findings"])
def test_tasks_follow_the_size_of_the_table(spark, monkeypatch, query):
    monkeypatch.setattr(staging, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = shuffles_by_document(__spark_entry__.queries()[query](spark, SF))
    assert found == {-(-lines // 500)}  # all steps keep the dealing; none goes back to the number of partitions of the session


def test_margins_of_two_profiles_in_one_pass(spark):
    margins = "top_margin_cm double, bottom_margin_cm double, left_margin_cm double, right_margin_cm double"
    right = {1: [1.0, 1.5, 1.5, 1.5], 2: [1.5], 3: [1.0, 1.2]}
    sections = spark.createDataFrame([(d, i, 2.0, 2.0, 3.0, r) for d, rs in right.items() for i, r in enumerate(rs)] + [(None, 0, 2.0, 2.0, 3.0, 1.0)], f"doc_id int, section_ix int, {margins}")
    rules = spark.createDataFrame([("p", "right_margin", "min", 1.2), ("p", "left_margin", "equals", 3.0), ("q", "right_margin", "max", 1.1)], "profile_id string, parameter string, operator string, value_num double")
    targets = {(r.doc_id, r.profile_id): r.target.right_margin for r in documents.margin_targets(sections, rules).collect()}
    assert targets == {(1, "p"): 1.5, (1, "q"): 2.5, (3, "p"): 2.5, (3, "q"): 2.5}
    valid = documents.margin_validity(sections, rules).where("valid").select("doc_id", "section_ix", "profile_id")
    assert sorted(rows(valid)) == [(1, 0, "q"), (1, 1, "p"), (1, 2, "p"), (1, 3, "p"), (2, 0, "p"), (3, 0, "q"), (3, 1, "p")]


def test_consistency_findings_give_way_inside_their_place(spark):
    none = {c: None for c in violations.COLUMNS}
    made = [{**none, "doc_id": d, "profile_id": p, "paragraph_index": ix, "parameter": "x", "source_section": s} for d, p, ix, s in [(1, "p", 0, "4.1"), (1, "p", 0, "2"), (1, "q", 0, "4.1"), (1, "p", 1, "4.1"), (1, "p", 2, None), (1, "p", 2, "4.1"), (1, "p", None, "4.1"), (1, "p", None, "2"), (None, "p", 0, "4.1"), (None, "p", 0, "2")]]
    kinds = ", ".join(f"{c} {'int' if c == 'doc_id' or c.endswith('_index') else 'string'}" for c in violations.COLUMNS)
    kept = violations.without_consistency_duplicates(spark.createDataFrame([tuple(m[c] for c in violations.COLUMNS) for m in made], kinds))
    expected = [(1, "p", 0, "2"), (1, "q", 0, "4.1"), (1, "p", 1, "4.1"), (1, "p", 2, None), (1, "p", None, "4.1"), (1, "p", None, "2"), (None, "p", 0, "4.1"), (None, "p", 0, "2")]
    assert sorted(map(str, rows(kept.select("doc_id", "profile_id", "paragraph_index", "source_section")))) == sorted(map(str, expected))
    assert " Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
