"""The families of rules on a small thesis with known faults."""

import pytest

from quillcheck.operators import derive, documents, formatting, objects, typography, violations
from quillcheck.plans.check import Blocks, check
from tests import fixtures


@pytest.fixture(scope="module")
def thesis(spark):
    df = derive.prepared(fixtures.paragraphs(spark, fixtures.THESIS))
    return df.cache()


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def by_parameter(df, parameter, column="para_ix"):
    return sorted(r[0] for r in df.where(f"parameter = '{parameter}'").select(column).collect())


def test_classification(thesis):
    rows = {r.para_ix: r for r in thesis.collect()}
    assert [rows[i].paragraph_type for i in range(21)] == ["title_page"] * 4 + ["heading", "main_text", "list_item", "list_item", "list_item", "main_text", "heading", "main_text", "caption", "main_text", "caption", "heading", "main_text", "heading", "list_item", "table_cell", "table_cell"]
    assert [rows[i].logical_section for i in (0, 4, 9, 11, 16, 18, 20)] == ["title_page", "introduction", "introduction", "main_part", "conclusion", "references", None]
    assert (rows[12].caption_kind, rows[12].caption_number, rows[12].caption_title) == ("figure", "1", "— схема.")
    assert rows[10].is_numbered_heading and rows[10].heading_level == 1 and rows[4].is_structural_heading
    assert [rows[i].list_marker_type for i in (6, 8, 18)] == ["dash", "hyphen", "number_dot"]


def test_typography(thesis):
    df = typography.fragments(thesis)
    assert by_parameter(df, "repeated_spaces") == [9]
    assert got(df.where("parameter = 'spaces_near_punctuation'"), "para_ix", "fragment") == [(9, " ,")]
    assert got(df.where("parameter = 'numeric_range_dash'"), "para_ix", "fragment") == [(9, "5-7")]
    assert got(df.where("parameter = 'nbsp_after_figure_table_reference'"), "para_ix", "fragment") == [(9, "рис. 1"), (12, "Рисунок 1"), (13, "табл. 2"), (14, "Таблица 3")]
    lists = typography.list_consistency(thesis)
    assert got(lists.where("parameter = 'list_marker_consistency'"), "para_ix", "fragment") == [(8, "hyphen -")]
    assert got(lists.where("parameter = 'list_punctuation_policy'"), "para_ix", "fragment") == [(8, "starts with a capital")]


CASES = [
    ("слово  слово", "repeated_spaces", "  "), ("( слово", "spaces_inside_brackets_quotes", "( "), ("слово )", "spaces_inside_brackets_quotes", " )"), ("рис. 1 а", "number_letter_no_space", "рис. 1 а"), ("г. Москва", "nbsp_after_abbreviations", "г. "), ("А. С. Пушкин", "nbsp_between_initials", "А. С. Пушкин"),
    ("№ 5", "nbsp_after_number_sign", "№ 5"), ("§ 5", "nbsp_after_paragraph_sign", "§ 5"), ("длина 5 см", "unit_nbsp", "5 см"), ("и / или", "slash_without_spaces", " / "), ("5x7", "multiplication_symbol", "x"), ("10 oC", "degree_symbol", "10 o"), ("5 – 7", "numeric_range_dash", "5 – 7"), ("20°C", "temperature_nbsp", "20°C"),
    ("5 %", "percent_nbsp", "5 %"), ("Вт·ч", "dimension_operator_spacing", "Вт·ч"), ("5 кг. и", "no_dot_after_units", "5 кг."), ("5 см, 6 см", "unit_only_after_last_number", "5 см, 6 см"), ("число 1234567", "digit_grouping_nbsp", "1234567"), ("кто - то", "hyphen_spacing", "о - т"), ("перенос-", "manual_hyphenation_forbidden", "с-"),
    ("да—нет", "dash_spacing", "а—н"), ('он сказал "да"', "russian_quotes", '"да"'), ("«а «б» в»", "nested_quotes", "«а «б» в»"), ("No 5", "number_sign_symbol", "No 5"), ("слово/знак/", "parentheses_not_slash", "слово/знак/"), ("текст […]", "citation_omission_format", "[…]"), ("[примечание]", "square_brackets_usage", "[примечание]"),
    ("C-dur", "music_terms_typography", "C-dur"), ("тел. +74951234567", "phone_number_format", "+74951234567"), ("3.14", "decimal_separator_comma", "3.14"), (" край", "paragraph_edge_spaces", "space at the edge"),
]


def test_patterns(spark):
    df = typography.fragments(fixtures.paragraphs(spark, [{"text": t} for t, _, _ in CASES]))
    found = {(r.para_ix, r.parameter, r.fragment) for r in df.collect()}
    assert [(i, p, f) for i, (_, p, f) in enumerate(CASES) if (i, p, f) not in found] == []


def test_clean_text_has_no_findings(spark):
    clean = ["Обычный текст без нарушений.", "Телефон +7 495 123-45-67.", "Версия 1.2.3 [5, с.\u00a010]", "Тире — верно, 5–7 страниц."]
    assert typography.fragments(fixtures.paragraphs(spark, [{"text": t} for t in clean])).where("parameter not in ('digit_grouping_nbsp', 'numeric_range_dash', 'hyphen_instead_of_minus', 'minus_symbol')").count() == 0


def test_headings(thesis):
    df = formatting.heading_faults(thesis)
    assert by_parameter(df, "starts_with_capital") == [10]
    assert by_parameter(df, "numbering_terminal_dot") == [10]
    assert by_parameter(df, "heading_font_size_hierarchy") == [10]
    assert by_parameter(df, "page_break_before") == [10]
    assert by_parameter(df, "heading_spacing_order") == [10]


def test_parameter_rules(spark, thesis):
    rules = fixtures.rules(spark, {"target": "main_text", "parameter": "font_size", "value": 14, "unit": "pt"}, {"target": "main_text", "parameter": "alignment", "operator": "in", "value": ["justify", "center"]}, {"target": "main_text", "parameter": "font_size", "operator": "min", "value": 12.5, "unit": "pt", "modality": "recommended"})
    df = formatting.check_parameters(thesis, rules)
    assert got(df.where("rule_id = 'r0'"), "paragraph_index", "actual", "expected", "severity") == [(11, "12 pt", "14 pt", "error")]
    assert got(df.where("rule_id = 'r1'"), "paragraph_index", "actual", "expected") == [(13, "left", "justify or center")]
    assert df.where("rule_id = 'r2'").count() == 0  # 12 is inside the tolerance of half a point
    assert formatting.check_parameters(thesis, rules.limit(0)).count() == 0


def test_objects(thesis):
    figures = objects.figure_caption_faults(thesis)
    assert by_parameter(figures, "figure_caption_position") == [12] and by_parameter(figures, "figure_caption_terminal_dot") == [12] and by_parameter(figures, "figure_caption_title_format") == [12]
    tables = objects.reference_faults(objects.first_references(thesis, objects.TABLE_REFERENCE, "table_cell"), objects.captions_of(thesis, "table"), "t", True)
    assert got(tables, "actual", "level") == [("2: caption missing", "error"), ("3: never referred to", "warning")]
    pictures = objects.reference_faults(objects.first_references(thesis, objects.FIGURE_REFERENCE), objects.captions_of(thesis, "figure"), "f", False)
    assert pictures.count() == 0
    cells = objects.cell_faults(thesis)
    assert got(cells.where("parameter = 'table_text_spacing_indent'"), "table_ix", "para_ix", "actual") == [(0, 20, "alignment, indents, line spacing")]


def test_structure_and_language(thesis):
    df = documents.structure_faults(thesis, required=["введение", "аннотация", "основная часть"], least_references=2, intro_items=["цели и задачи"])
    found = {r.parameter: r.actual for r in df.collect()}
    assert found["required_document_structure"] == "аннотация" and found["references_min_count"] == "1" and "conclusion_required_content" not in found
    language = documents.language_faults(thesis, phrases=["литературу", "вы"])
    assert got(language.where("parameter = 'initial_verb_form'"), "para_ix", "actual") == [(7, "разработка")]
    assert got(language.where("parameter = 'completed_action_form'"), "para_ix", "actual") == [(16, "планируется")]
    assert got(language.where("parameter = 'forbidden_phrases'"), "para_ix", "actual") == [(6, "литературу")]


def test_consistency(spark, thesis):
    rules = fixtures.rules(spark, {"target": "main_text", "parameter": "consistency", "operator": "consistent", "category": "consistency", "strategy": '{"alignment": {"preferred_value": "justify"}}'})
    chosen = {(r.parameter): (r.chosen, r.reason) for r in documents.chosen_values(thesis, rules).collect()}
    assert chosen["alignment"] == ("justify", "profile") and chosen["font_size"] == ("14", "dominant") and chosen["line_spacing"] == ("1.5", "preferred")
    assert got(documents.consistency_faults(thesis, rules), "para_ix", "parameter", "actual", "expected") == [(11, "font_size", "12", "14"), (13, "alignment", "left", "justify")]


def test_sections(spark, thesis):
    schema = "doc_id long, section_ix int, page_width_cm double, page_height_cm double, top_margin_cm double, bottom_margin_cm double, left_margin_cm double, right_margin_cm double, header_distance_cm double, footer_distance_cm double, page_format string, page_orientation string, has_header boolean, header_text string, has_page_number boolean, page_number_area string, page_number_alignment string, page_number_start int, page_number_restart boolean, first_page_has_page_number boolean"
    row = lambda i, left, **k: (1, i, 21.0, 29.7, 2.0, 2.0, left, 1.5, 1.25, 1.25, "A4", "portrait", False, "", True, k.get("area", "footer"), "center", k.get("start"), k.get("restart", False), i == 0)
    sections = spark.createDataFrame([row(0, 3.0), row(1, 3.0, start=5, restart=True), row(2, 2.0, area="header")], schema)
    rules = fixtures.rules(spark, {"target": "page", "parameter": "left_margin", "operator": "min", "value": 2.0, "unit": "cm"}, {"target": "page", "parameter": "left_margin", "value": 3.0, "unit": "cm"}, {"target": "page", "parameter": "page_format", "value": "a4"})
    assert got(documents.check_sections(sections, rules), "section_index", "parameter", "actual") == [(2, "left_margin", "2 cm")]
    faults = documents.section_faults(sections, thesis)
    assert got(faults, "section_ix", "parameter") == [(0, "first_page_no_page_number"), (0, "front_matter_page_numbers_hidden_until_intro"), (1, "continuous_page_numbering"), (2, "page_number_area")]
    minimum = fixtures.rules(spark, {"target": "page", "parameter": "left_margin", "operator": "min", "value": 2.0})
    margins = documents.margin_consistency(sections, minimum)
    assert got(margins, "section_ix", "actual") == [(2, "top 2, bottom 2, left 2, right 1.5")]


def test_whole_check(spark, thesis, tmp_path):
    empty = lambda schema: spark.createDataFrame([], schema)
    sections = empty("doc_id long, section_ix int, page_width_cm double, page_height_cm double, top_margin_cm double, bottom_margin_cm double, left_margin_cm double, right_margin_cm double, header_distance_cm double, footer_distance_cm double, page_format string, page_orientation string, has_header boolean, header_text string, has_page_number boolean, page_number_area string, page_number_alignment string, page_number_start int, page_number_restart boolean, first_page_has_page_number boolean")
    tables = spark.createDataFrame([(1, 0, 2, 1, None, 18, None, True, None, "left", True, "auto", 0.5, False, False, [], [])], "doc_id long, table_ix int, rows_count int, columns_count int, title_para_ix int, paragraph_before_ix int, paragraph_after_ix int, has_header_row boolean, width_cm double, alignment string, has_grid boolean, border_color string, border_size double, has_cant_split_rows boolean, repeats_header boolean, empty_row_ix array<int>, enlarged_row_ix array<int>")
    images = empty("doc_id long, image_ix int, para_ix int, width_cm double, height_cm double, width_px int, height_px int, extension string, is_inline boolean")
    meta = spark.createDataFrame([(1, "a", False, None, None)], "doc_id long, file_path string, has_footnotes_part boolean, footnote_number_format string, footnote_number_restart string")
    rules = fixtures.rules(
        spark,
        {"target": "main_text", "parameter": "font_size", "value": 14, "unit": "pt"}, {"parameter": "repeated_spaces"}, {"parameter": "empty_paragraph_between_content"}, {"parameter": "table_caption_position"}, {"parameter": "table_text_spacing_indent"}, {"parameter": "starts_with_capital", "target": "heading"},
        {"parameter": "required_document_structure", "value": ["аннотация"], "category": "structure"}, {"parameter": "consistency", "operator": "consistent", "target": "main_text", "section": "4.1"}, {"parameter": "forbidden_phrases", "value": ["литературу"], "modality": "recommended"},
    )
    check(Blocks(thesis, sections, tables, images, meta), rules).write.parquet(str(tmp_path / "found"))  # once, for all that follows
    found = spark.read.parquet(str(tmp_path / "found"))
    rows = got(found, "rule_id", "paragraph_index", "table_index", "severity")
    assert ("r0", 11, None, "error") in rows and ("r1", 9, None, "error") in rows and ("r3", None, 0, "error") in rows and ("r4", 20, 0, "error") in rows and ("r5", 10, None, "error") in rows and ("r6", None, None, "error") in rows and ("r8", 6, None, "warning") in rows
    assert not [r for r in rows if r[0] in ("r2",)] and not [r for r in rows if r[1] is not None and r[1] < 4]
    summary = {r.rule_id: r.n for r in violations.grouped(found).collect()}
    assert summary["r1"] == 1
    assert violations.counts(found, "doc_id").first().n_warnings == 1
    assert violations.report_rows(found).count() == found.count()
    notes = violations.anchored(violations.comments(found), tables)
    assert {r.anchor_ix for r in notes.where("table_index = 0").collect()} == {18}
