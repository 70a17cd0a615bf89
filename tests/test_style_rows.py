"""Style chains inside one row, and by joins for large documents."""

from pathlib import Path

import pytest

from quillcheck.operators import derive
from quillcheck.sources.staging import shared_folder

STYLES = [
    (1, "a", None, "center"), (1, "b", "a", None), (1, "c", "b", None), (1, "x", "y", None), (1, "y", "x", None), (1, "m", "missing", None), (1, "c", "x", None),
    (2, "a", "b", None), (2, "b", "c", None), (2, "c", "d", None), (2, "d", "e", None), (2, "e", None, "left"), (None, "p", None, "right"), (None, "q", "p", None), (3, None, "a", "left"), (4, "s", "s", None),
]
FOLLOWED = [("None", "p", "right"), ("1", "a", "center"), ("1", "b", "center"), ("1", "c", "center"), *(("2", s, "left") for s in "abcde")]


@pytest.mark.parametrize("most", [256, 6, 1])
def test_chains_in_rows_and_by_joins(spark, monkeypatch, most):
    monkeypatch.setattr(derive, "STYLES_IN_A_ROW", most)
    found = derive.style_alignments(spark.createDataFrame(STYLES, "doc_id long, style_id string, based_on string, alignment string"))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == sorted(FOLLOWED)


def test_small_documents_are_not_written(spark):
    tables = lambda: len(list(Path(shared_folder(spark).removeprefix("file:")).rglob("style-links*")))
    before = tables()
    derive.style_alignments(spark.createDataFrame(STYLES, "doc_id long, style_id string, based_on string, alignment string")).collect()
    assert tables() == before
