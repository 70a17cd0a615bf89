from quillcheck.functions import fixed
from quillcheck.operators import prefilter, typography
from tests.conftest import rows

LINES = [
    (1, 0, "два  пробела", "main_text", None), (1, 1, "два  пробела", "note", None), (2, 0, "два  пробела", "caption", "table"), (2, 1, "Таблица 1 — Данные.", "caption", "table"), (2, 2, "Таблица 1 — Данные.", "caption", "figure"),
    (3, 0, "Сайт HTTPS://a.ru и 12.5 там", None, None), (3, 1, "WWW.a.ru и 12.5 там", None, None), (3, 2, "почта a.b@c.ru и 12 x 5", None, None), (3, 3, "гост р 1.5-2012 и 12 см", None, None), (3, 4, "[1] Иванов  И.", None, None), (3, 5, "", None, None), (3, 6, None, None, None), (3, 7, "длина 12 см тут", None, None),
]


def test_each_different_text_once(spark):
    df = spark.createDataFrame(LINES * 2, "doc_id int, para_ix int, text string, paragraph_type string, caption_kind string")
    plain, once = typography.fragments(df), typography.fragments(df, repeated=True)
    assert sorted(rows(once)) == sorted(rows(plain)) == sorted(rows(typography.fragments(df, filtered=False)))
    found = {(r[0], r[1], r[2]) for r in rows(once)}
    assert (1, 1, "dot_after_footnote_or_note") in found and (1, 0, "dot_after_footnote_or_note") not in found
    assert (2, 1, "no_dot_after_udc_keywords_table_title") in found and (2, 2, "no_dot_after_udc_keywords_table_title") not in found
    assert (3, 7, "unit_nbsp") in found and not any(d == 3 and i < 4 and p in fixed.VALUE_PARAMETERS for d, i, p in found)


def test_what_a_condition_holds_is_one_of_its_parts():
    shapes = {s for needs in prefilter.NEEDS.values() for s, _ in needs}
    assert set(prefilter.HOLDS) <= shapes and set(prefilter.LITERAL) <= set(prefilter.HOLDS)
