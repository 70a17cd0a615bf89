from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import corrections
from tests.conftest import rows


def test_number_texts_are_those_of_two_decimals(spark):
    numbers = [0.0, -0.0, 0.001, -0.001, 0.004999, 0.005, -0.005, 0.01, -0.01, 1.0, 10.0, 100.0, -20.5, 1.25, 0.125, 1.005, 2.675, 1.995, 12345678.9, 1e15, 1e16, -3.3e20, float("nan"), float("inf"), None] + [i / 1000 for i in range(-4000, 4000, 5)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    plain = F.when(F.col("x").isNotNull(), F.regexp_replace(F.format_string("%.2f", "x"), r"\.?0+$", ""))
    assert rows(df.where(~C.number_text("x").eqNullSafe(plain)).select("x", C.number_text("x"), plain)) == []


def test_values_are_judged_without_a_second_pass(spark):
    kinds = "profile_id string, ordinal int, target string, parameter string, operator string, value_num double, value_str string, value_bool boolean, value_list array<string>, consistency_strategy string"
    rules = spark.createDataFrame([("p", 0, "main_text", "font_size", "min", 12.0, None, None, None, None), ("p", 1, "main_text", "font_size", "in", None, None, None, ["12", "13.0"], None), ("q", 0, "main_text", "font_size", "equals", 99.0, None, None, None, None)], kinds)
    sizes = {1: [14, 14, 13], 2: [14, 15, 15], 3: [14, 14, 15, 15], 4: [11]}
    df = spark.createDataFrame([(d, i, "main_text", float(v)) for d, vs in sizes.items() for i, v in enumerate(vs)], "doc_id int, para_ix int, paragraph_type string, font_size_pt double")
    found = corrections.dominant_allowed(df, rules, ("font_size",))
    assert sorted(rows(found.select("profile_id", "doc_id", "value"))) == sorted([("p", 1, "13"), ("p", 2, "15"), ("p", 3, None), ("p", 4, "11"), ("q", 1, "14"), ("q", 2, "15"), ("q", 3, None), ("q", 4, "11")], key=lambda r: r[:2])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [doc_id") == 1  # the paragraphs are read once
