"""Sinks that may be written twice, groups of any size, settings of profiles, chains of styles."""

import pytest
from pyspark.sql import functions as F

from quillcheck.operators import derive, documents, extraction, settings, violations
from quillcheck.sources import blocks


def test_a_repeated_save_replaces_its_extraction(spark, tmp_path):
    path = str(tmp_path / "candidates")
    make = lambda e, *ps: spark.createDataFrame([(e, p) for p in ps], "extraction_id string, parameter string")
    blocks.save_candidates(make("e1", "x", "y"), path)
    blocks.save_candidates(make("e2", "z"), path)
    blocks.save_candidates(make("e1", "x", "w"), path)
    assert sorted(r.parameter for r in blocks.load_candidates(spark, path, "e1").collect()) == ["w", "x"]
    assert {(r.extraction_id, r.n_rows) for r in blocks.saved_extractions(spark, path).collect()} == {("e1", 2), ("e2", 1)}
    make("e3", "half").write.mode("append").partitionBy("extraction_id").parquet(path)  # rows without a line in the manifest
    with pytest.raises(ValueError, match="e3"):
        blocks.load_candidates(spark, path, "e3")


def test_a_repeated_run_replaces_its_summary(spark, tmp_path):
    row = {c: "1" for c in blocks.SUMMARY}
    found = spark.createDataFrame([row])
    path = str(tmp_path / "summary")
    for run in ("a", "b", "a"):
        blocks.write_summary(found, path, run)
    assert sorted(r.run for r in spark.read.json(path).collect()) == ["a", "b"]


def _found(spark, n):
    none = F.lit(None).cast("int")
    return spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source_section"), (F.col("id") % 2).cast("string").alias("rule_id"), F.concat(F.lit("p "), F.col("id")).alias("location"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("paragraph_index"), none.alias("section_index"), F.lit("m").alias("message"), F.lit("a").alias("actual"), F.lit("b").alias("expected"), F.lit("error").alias("severity"))


def test_places_of_a_large_group_are_cut_before_they_meet(spark):
    got = {r.rule_id: (r.n, r.places) for r in violations.grouped(_found(spark, 200_000)).collect()}
    assert got["0"] == (100_000, ", ".join(str(2 * i) for i in range(12)) + "...")
    assert got["1"] == (100_000, ", ".join(sorted(f"p {i}" for i in range(1, 200_000, 2))[:8]) + "...")
    plan = violations.grouped(_found(spark, 10))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and plan.count("collect_set") == 0
    few = {r.rule_id: r.places for r in violations.grouped(_found(spark, 5)).collect()}
    assert few == {"0": "0, 2, 4", "1": "p 1, p 3"}


def test_groups_without_section_or_rule(spark):
    rows = _found(spark, 4).withColumn("source_section", F.lit(None).cast("string")).withColumn("rule_id", F.lit(None).cast("string"))
    assert [(r.source_section, r.rule_id, r.n, r.places) for r in violations.grouped(rows).collect()] == [("", None, 4, "0, 2")]


def test_settings_name_the_profile_that_is_broken(spark):
    rules = spark.createDataFrame([("p", 1, "x", 5.0, True), ("p", 0, "x", 3.0, True), ("q", 0, "x", 9.0, True), ("r", 0, "x", 1.0, False), ("s", 0, "y", 2.0, True)], "profile_id string, ordinal int, parameter string, value_num double, enabled boolean")
    found = settings.of_rules(rules, {"x": (F.col("value_num"), ("x",)), "any": (F.when(F.col("parameter") == "y", F.col("value_num")), ())})
    shown = spark.range(1).select(found["x"].alias("x"), found["any"].alias("any")).first()
    assert [(s.profile_id, s.value) for s in shown.x] == [("p", 3.0), ("q", 9.0)]
    assert [(s.profile_id, s.value) for s in shown["any"]] == [("p", None), ("q", None), ("r", None), ("s", 2.0)]
    faults = settings.faults(found["x"], lambda v: F.col("id") > v, "x", F.col("id"), lambda v: v)
    got = spark.range(4, 11, 6).select("id", F.explode(faults).alias("f")).select("id", "f.*").collect()
    assert {(r.id, r.profile_id, r.expected) for r in got} == {(4, "p", "3.0"), (10, "p", "3.0"), (10, "q", "9.0")}


def test_parts_named_across_borders(spark):
    rows = [(1, 0, "список"), (1, 1, "использованных"), (1, 2, ""), (1, 3, "источников и"), (2, 0, "список использованных"), (2, 1, "x"), (2, 2, "источников"), (3, 0, None)]
    p = spark.createDataFrame(rows, "doc_id long, para_ix int, text string").withColumns({"paragraph_type": F.lit("main_text"), "is_numbered_heading": F.lit(False)})
    assert {r.doc_id for r in documents.missing_parts(p, ["Список использованных источников"]).collect()} == {2, 3}


def test_long_chains_circles_and_missing_styles(spark):
    chain = [(1, f"s{i}", f"s{i - 1}" if i else None, "center" if i == 0 else None) for i in range(130)]
    other = [(2, "a", "b", None), (2, "b", "c", None), (2, "c", "a", None), (2, "d", "a", None), (2, "e", "none", None), (2, "f", "e", "left"), (2, "g", "f", None), (2, None, "f", "right")]
    got = derive.style_alignments(spark.createDataFrame(chain + other, "doc_id int, style_id string, based_on string, alignment string")).collect()
    assert {(r.doc_id, r.style_id): r.alignment for r in got} == {**{(1, f"s{i}"): "center" for i in range(130)}, (2, "f"): "left", (2, "g"): "left"}


def test_parts_of_a_work_in_the_order_of_the_statements(spark):
    texts = ["Работа имеет следующую структуру и включает:", "введение и реферат", "содержание", "реферат"]
    rows = [("d", 0, "4.1", i, 0, t, "requirement", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_document string, section_ix int, number string, fragment_ix int, statement_ix int, text string, fragment_type string, modality string")
    found = extraction.structural_candidates(df).where("parameter = 'required_document_structure'").collect()
    assert [r.value_text for r in found] == ["реферат; введение; содержание"]
