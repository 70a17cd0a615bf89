"""Derivations from raw attributes, rule extraction, corrections, sources and sinks."""

import json

from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import corrections, derive, extraction, typography, violations
from quillcheck.sources import blocks
from tests import fixtures


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_column_functions(spark):
    r = one(
        spark, cm=C.emu_to_cm(F.lit(720000)), pt=C.emu_to_pt(F.lit(177800)), a4=C.page_format(F.lit(29.6), F.lit(21.1)), odd=C.page_format(F.lit(10.0), F.lit(12.5)), land=C.orientation(F.lit(3), F.lit(2)), none=C.number_text(F.lit(None).cast("double")), two=C.number_text(F.lit(2.50)),
        lines=C.joined_lines(F.array(F.lit(" a "), F.lit(" "), F.lit("b"))), cells=C.table_row_text(F.array(F.lit("a  b"), F.lit(""), F.lit("c"))), nbsp=C.nbsp_count(F.lit("a\u00a0b\u00a0c")), auto=C.run_color(F.lit("x"), F.lit("auto")), rgb=C.run_color(F.lit("ff00aa"), F.lit("rgb")), ext=C.extension(F.lit("media/Image.PNG")),
        level=C.style_heading_level(F.lit("Заголовок 2")), role=C.style_heading_level(F.lit("Point Heading")), number=C.number_heading_level(F.lit("2.1.3 Текст")), plural=C.plural(F.lit(22), "a", "b", "c"), eleven=C.plural(F.lit(11), "a", "b", "c"), marker=C.automatic_marker_type(F.lit("decimal"), F.lit("%1)")), roman=C.automatic_marker_type(F.lit("lowerRoman"), F.lit("")),
    )
    assert (r.cm, r.pt, r.a4, r.odd, r.land, r.none, r.two) == (2.0, 14.0, "A4", "10 x 12.5 cm", "landscape", None, "2.5")
    assert (r.lines, r.cells, r.nbsp, r.auto, r.rgb, r.ext) == ("a\nb", "a b | c", 2, "000000", "FF00AA", "png")
    assert (r.level, r.role, r.number, r.plural, r.eleven, r.marker, r.roman) == (2, 3, 3, "b", "c", "number_bracket", "letter_dot")
    q = one(spark, e=C.equation_flags(F.lit("x = 1 (2.1)"), F.lit(1), F.lit(0)), i=C.equation_flags(F.lit("(3)"), F.lit(0), F.lit(1)))
    assert (q.e.equation_number, q.e.is_standalone_equation, q.i.has_formula_like_image, q.i.has_equation) == ("(2.1)", True, True, False)


def test_predicate(spark):
    rules = fixtures.rules(spark, {"parameter": "a", "value": 14, "unit": "pt"}, {"parameter": "a", "operator": "min", "value": 10}, {"parameter": "a", "operator": "in", "value": [12, 14]}, {"parameter": "a", "operator": "contains", "value": 14}, {"parameter": "a", "value": True})
    ok = rules.orderBy("ordinal").select(C.satisfies(F.lit(14.4), F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("v"), C.satisfies(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("boolean")).alias("null"))
    rows = ok.collect()
    assert [r.v for r in rows] == [True, True, False, False, True] and not any(r.null for r in rows)


def test_style_cascade(spark):
    styles = spark.createDataFrame([(1, "Normal", None, None, "Arial", 12.0, False), (1, "Base", None, "center", None, None, True), (1, "Child", "Base", None, "Times", None, None)], "doc_id long, style_id string, based_on string, alignment string, font_family string, font_size_pt double, bold boolean")
    for name, kind in (("italic", "boolean"), ("first_line_indent_cm", "double"), ("left_indent_cm", "double"), ("right_indent_cm", "double"), ("line_spacing", "double"), ("space_before_pt", "double"), ("space_after_pt", "double"), ("keep_with_next", "boolean"), ("keep_together", "boolean"), ("page_break_before", "boolean")):
        styles = styles.withColumn(name, F.lit(None).cast(kind))
    assert {(r.style_id, r.alignment) for r in derive.style_alignments(styles).collect()} == {("Base", "center"), ("Child", "center")}
    schema = "doc_id long, para_ix int, style_id string, runs array<struct<text:string,font_family:string,font_size_pt:double,bold:boolean,italic:boolean>>, alignment string, line_rule string, line_spacing double, first_line_indent_cm double, left_indent_cm double, right_indent_cm double, space_before_pt double, space_after_pt double, keep_with_next boolean, keep_together boolean, page_break_before boolean"
    rows = spark.createDataFrame([(1, 0, "Child", [(" ", "X", 9.0, True, None), ("a", None, 14.0, True, None), ("b", None, None, None, None)], None, "exact", 18.0, None, None, None, None, 6.0, None, None, None)], schema)
    r = derive.paragraph_effects(rows, styles).first()
    assert (r.alignment, r.font_family, r.font_size_pt, r.bold, r.italic, r.line_spacing, r.first_line_indent_cm, r.space_after_pt) == ("center", "Times", 14.0, False, False, None, 0.0, 6.0)


def test_tables_and_captions(spark):
    body = spark.createDataFrame([(1, 0, False, 0, "table", "Таблица 1"), (1, 1, False, 1, None, "text"), (1, 2, True, None, None, None), (1, 3, True, None, None, None), (1, 4, False, 2, None, "Продолжение таблицы 1"), (1, 5, True, None, None, None)], "doc_id long, block_ix int, is_table boolean, para_ix int, caption_kind string, text string")
    assert {(r.table_ix, r.title_para_ix, r.paragraph_before_ix) for r in derive.table_contexts(body).collect()} == {(0, 0, 1), (1, None, 1), (2, 2, 2)}
    border = [("single", "auto", 4)]
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, "h", 800, False, True, border), (1, 0, 0, 1, 1, "h", 800, False, True, border), (1, 0, 1, 0, 2, " ", 300, True, False, border), (1, 0, 1, 1, 3, "", 300, True, False, border)], "doc_id long, table_ix int, row_ix int, col_ix int, cell_id long, text string, row_height_twips int, cant_split boolean, repeats_header boolean, borders array<struct<val:string,color:string,size:int>>")
    r = derive.table_facts(cells).first()
    assert (r.rows_count, r.columns_count, r.empty_row_ix, r.enlarged_row_ix, r.has_header_row, r.has_grid, r.border_size, r.has_cant_split_rows) == (2, 2, [1], [0], True, True, 0.5, True)


REGULATION = """1.1 Общие требования
Основной текст должен быть набран шрифтом Times New Roman, кегль 14 пт.
Межстрочный интервал должен быть полуторный.
Поля: слева — 3 см, справа — 15 мм.
Абзацный отступ рекомендуется 1,25 см.
Примечание: допускается иное.
2.1 Заголовки
Размер шрифта заголовка на 2 пт больше основного текста.
Кегль заголовков должен быть 14 или 16 пт.
Список источников должен содержать не менее 20 источников.
В качестве маркера допускается только тире.
12"""


def test_extraction(spark):
    rows = spark.createDataFrame([("reg", i, t) for i, t in enumerate(REGULATION.split("\n"))], "source_document string, block_ix int, text string")
    parts = extraction.sections(extraction.typed_blocks(rows))
    assert [(r.number, r.text.count("\n")) for r in parts.orderBy("section_ix").collect()] == [("1.1", 5), ("2.1", 4)]
    found = extraction.extracted(rows)
    values = {(r.target, r.parameter, r.operator, r.value_text): r for r in found.collect()}
    assert ("main_text", "font_size", "equals", "14") in values and ("main_text", "font_family", "equals", "Times New Roman") in values
    assert ("page", "left_margin", "equals", "3") in values and ("page", "right_margin", "equals", "1.5") in values
    assert values["main_text", "font_size", "equals", "14"].modality == "mandatory"
    assert any(p == "line_spacing" and v == "1.5" for _, p, _, v in values) and any(p == "first_line_indent" and v == "1.25" for _, p, _, v in values)
    assert any(p == "font_size" and o == "in" and v == "14 / 16" for _, p, o, v in values)
    assert any(r.status == "unsupported" and r.delta == 2.0 for r in values.values())
    assert ("document", "references_min_count", "equals", "20") in values and ("document", "list_marker_dash_required", "equals", "true") in values
    assert all(0 <= r.confidence <= 1 for r in values.values())
    accepted = found.where("parameter in ('left_margin', 'font_family')").select("source_document", "id")
    profile = extraction.profile_rules(extraction.confirmed(found, accepted))
    assert {(r.parameter, r.category) for r in profile.collect()} == {("left_margin", "formatting"), ("font_family", "formatting")}
    assert extraction.views(found).agg(F.sum("n")).first()[0] == len(values)
    assert extraction.extracted(rows.limit(0)).count() == 0


def test_continuations_and_contents(spark):
    rows = spark.createDataFrame([("d", 0, "Оглавление", 1), ("d", 1, "1 Введение ..... 5", 1), ("d", 2, "Начало строки пере-", 2), ("d", 3, "нос идёт дальше", 2), ("d", 4, "без точки.", 2), ("d", 5, "Новый абзац", 2)], "source_document string, block_ix int, text string, page_number int")
    kept = extraction.without_contents_pages(extraction.typed_blocks(rows))
    assert [r.text for r in extraction.merged_continuations(kept).orderBy("block_ix").collect()] == ["Начало строки перенос идёт дальше без точки.", "Новый абзац"]


def test_safe_text(spark):
    cases = {
        "a  b": ("repeated_spaces", "a b"), "слово , да": ("spaces_near_punctuation", "слово, да"), "N 5": ("number_sign_symbol", "№\u00a05"), "5-7 стр": ("numeric_range_dash", "5–7 стр"), "кто - то": ("dash_spacing", "кто — то"), '"да"': ("russian_quotes", "«да»"), "5x7": ("multiplication_symbol", "5×7"),
        "2.5 см": ("decimal_separator_comma", "2,5 см"), "20°C": ("temperature_nbsp", "20\u00a0°C"), "5 %": ("percent_nbsp", "5\u00a0%"), "5 кг": ("unit_nbsp", "5\u00a0кг"), "[...]": ("citation_omission_format", "<...>"), "+74951234567": ("phone_number_format", "+7 495 123-45-67"), "84951234567": ("phone_number_format", "8 495 123-45-67"), "(495)123-45-67": ("phone_number_format", "495 123-45-67"),
    }
    got = one(spark, **{f"c{i}": corrections.safe_text(F.lit(t), (p,)) for i, (t, (p, _)) in enumerate(cases.items())})
    assert list(got) == [w for _, w in cases.values()]
    again = one(spark, **{f"c{i}": corrections.safe_text(F.lit(w), (p,)) for i, (p, w) in enumerate(cases.values())})
    assert list(again) == [w for _, w in cases.values()]  # a second pass changes nothing


def test_plans(spark):
    df = derive.prepared(fixtures.paragraphs(spark, fixtures.THESIS)).cache()
    rules = fixtures.rules(spark, {"target": "main_text", "parameter": "font_size", "value": 14}, {"target": "main_text", "parameter": "consistency", "operator": "consistent"}, {"target": "section_heading", "parameter": "font_size", "value": 16}, {"target": "heading", "parameter": "font_size", "value": 15})
    assert {(r.para_ix, r.old_value, r.new_value) for r in corrections.main_text_plan(df, rules).where("parameter = 'font_size'").collect()} == {(11, "12", "14")}
    heads = {(r.para_ix, r.old_value, r.new_value) for r in corrections.heading_plan(df, rules).where("parameter = 'font_size'").collect()}
    assert heads == {(10, "14", "16"), (4, "16", "15"), (15, "16", "15"), (17, "16", "15")}
    lists = {r.para_ix: r.new_value for r in corrections.list_plan(df).collect()}
    assert lists == {7: "— разработка модели;", 8: "— проверить."} or lists == {8: "— проверить."}
    captions = {r.para_ix: r.new_value for r in corrections.caption_plan(df, {"figure": "Рисунок"}).where("parameter = 'caption_text'").collect()}
    assert captions[12] == "Рисунок 1 — схема"
    assert corrections.without_empty(df).count() == df.count()
    assert {r[0] for r in one(spark, c=F.array(F.struct(corrections.clamped(F.lit(9.0), F.lit(11.0), F.lit(13.0))))).c} == {11.0}


def test_sources_and_sinks(spark, tmp_path):
    profile = {"id": "p1", "name": "Профиль", "rules": [{"id": "a", "category": "formatting", "target": "main_text", "parameter": "font_size", "operator": "equals", "value": 14, "modality": "mandatory"}, {"id": "b", "category": "x", "target": "page", "parameter": "page_format", "operator": "in", "value": ["A4", "A5"], "modality": "mandatory"}]}
    (tmp_path / "p.json").write_text(json.dumps(profile, ensure_ascii=False), encoding="utf-8")
    rules = blocks.read_profiles(spark, str(tmp_path / "p.json"))
    assert [(r.rule_id, r.ordinal, r.value_num, r.value_list) for r in rules.orderBy("ordinal").collect()] == [("a", 0, 14.0, None), ("b", 1, None, ["A4", "A5"])]
    assert [(r.rule_id, r.fault) for r in blocks.rule_faults(rules).collect()] == [("b", "unknown category")]
    text = blocks.profile_documents(rules).first().profile_json
    assert [r["id"] for r in json.loads(text)["rules"]] == ["a", "b"]
    kept = spark.createDataFrame([("e1", "x"), ("e2", "y")], "extraction_id string, parameter string")
    blocks.save_candidates(kept, str(tmp_path / "c"))
    assert [r.parameter for r in blocks.load_candidates(spark, str(tmp_path / "c"), "e2").collect()] == ["y"]


def test_notations_and_equations(spark):
    df = derive.prepared(fixtures.paragraphs(spark, [{"text": "5×7"}, {"text": "5·7"}, {"text": "E = mc (1)", "has_equation": True}, {"text": "по формуле (2)"}, {"text": "+7 495 123-45-67"}, {"text": "8 495 123-45-67"}]))
    mixes = {r.parameter: r.fragment for r in typography.notation_mixes(df).collect()}
    assert mixes["multiplication_sign_consistency"] == "·, ×" and mixes["phone_country_code_consistency"] == "+7, 8"
    assert {(r.fragment, r.level) for r in typography.equation_reference_gaps(df).collect()} == {("1", "warning"), ("2", "error")}


def test_section_order(spark):
    rows = spark.createDataFrame([("10.1",), ("2.3",), ("",), ("A",), ("2.10",)], "s string").orderBy(violations.section_key(F.col("s")))
    assert [r.s for r in rows.collect()] == ["2.3", "2.10", "10.1", "A", ""]
