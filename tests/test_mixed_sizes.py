"""Sizes of a paragraph's runs are compared inside its row."""

from quillcheck.operators import formatting
from tests.fixtures import paragraphs, run


def test_mixed_sizes_in_one_row(spark):
    df = paragraphs(
        spark,
        [
            {"text": "one size", "runs": [run(0, "a", 14.0), run(1, "b", 14.04), run(2, " ", 9.0)]},
            {"text": "the most frequent", "runs": [run(0, "a", 11.0), run(1, "b", 12.0), run(2, "c", 12.0), run(3, "d", None), run(4, "e", 13.0), run(5, "f", 10.0), run(6, "g", 9.0)]},
            {"text": "the one seen first", "runs": [run(1, "a", 11.0), run(0, "b", 12.0)]},
            {"text": "", "runs": []},
        ],
    )
    found = formatting.mixed_sizes(df)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.para_ix, r.expected, r.actual) for r in found.collect()) == [(1, "12", "a: 11; e: 13; f: 10"), (2, "12", "a: 11")]
