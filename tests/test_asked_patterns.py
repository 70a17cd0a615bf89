"""Only the patterns that the rules ask for are looked for, with the findings that a profile of all rules has for them."""

from pyspark.sql import functions as F

from quillcheck.functions import fixed
from quillcheck.operators import derive, typography

from . import fixtures

TEXTS = ["два  пробела ( и скобка )", 'слова "в кавычках" и 12345 штук', "от 10-15 м и 3.14 по № 5", "— пункт списка", "5 %  и 7 кг", "диапазон 10-15"]
ASKED = [["numeric_range_dash", "russian_quotes", "digit_grouping_nbsp"], ["unit_nbsp", "spaces_inside_brackets_quotes"], ["paragraph_edge_spaces"], ["list_marker_allowed"], ["font_size"]]


def found(spark, paragraphs, names):
    rules = fixtures.rules(spark, *({"parameter": n} for n in names))
    return typography.check_paragraphs(paragraphs, rules, any_language=True)


def key(rows):
    return sorted(tuple(r) for r in rows.select("doc_id", "paragraph_index", "parameter", "actual", "severity").collect())


def test_same_findings_as_with_all_rules(spark):
    paragraphs = derive.prepared(fixtures.paragraphs(spark, [{"text": t} for t in TEXTS]))
    every = found(spark, paragraphs, sorted({p for p, *_ in fixed.TYPOGRAPHY} | set(typography.OTHERS))).localCheckpoint()
    for names in ASKED:
        assert key(found(spark, paragraphs, names)) == key(every.where(F.col("parameter").isin(names))), names


def test_patterns_of_other_rules_are_not_planned(spark):
    paragraphs = derive.prepared(fixtures.paragraphs(spark, [{"text": t} for t in TEXTS]))
    patterns = {p: x for p, x, _ in fixed.TYPOGRAPHY}
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = found(spark, paragraphs, ["digit_grouping_nbsp"])._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert patterns["digit_grouping_nbsp"] in plan and patterns["spaces_near_punctuation"] not in plan and "main_indent" not in plan
