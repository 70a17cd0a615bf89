"""Chains of styles, required parts over the whole text, profiles with their own values, encodings."""

import json


from quillcheck.functions import columns as C
from quillcheck.operators import derive, documents
from quillcheck.plans.check import Blocks, check
from quillcheck.sources import blocks
from tests import fixtures


def test_style_chains_of_any_length(spark):
    chain = [(1, f"S{i}", None, f"S{i + 1}") for i in range(60)] + [(1, "S60", "right", None), (1, "A", None, "B"), (1, "B", None, "A"), (1, "X", "left", "A"), (1, "Y", None, "missing"), (2, "S0", None, "S1")]
    styles = spark.createDataFrame(chain, "doc_id long, style_id string, alignment string, based_on string")
    got = {(r.doc_id, r.style_id): r.alignment for r in derive.style_alignments(styles).collect()}
    assert got == {**{(1, f"S{i}"): "right" for i in range(61)}, (1, "X"): "left"}


def test_required_parts_may_span_paragraphs(spark):
    p = fixtures.paragraphs(spark, [{"text": "Список"}, {"text": "литературы"}, {"text": "Введение."}])
    p = derive.prepared(p)
    got = {r.doc_id: r.missing for r in documents.missing_parts(p, ["список литературы", "Введение", "Заключение"]).collect()}
    assert got == {1: ["Заключение"]}


def test_profiles_keep_their_own_values(spark):
    p = derive.prepared(fixtures.paragraphs(spark, fixtures.THESIS))
    none = lambda columns: spark.createDataFrame([], columns)
    sections = none("doc_id long, section_ix int, page_width_cm double, page_height_cm double, page_format string, page_orientation string, top_margin_cm double, bottom_margin_cm double, left_margin_cm double, right_margin_cm double, header_distance_cm double, footer_distance_cm double, header_text string, has_header boolean, has_page_number boolean, first_page_has_page_number boolean, page_number_area string, page_number_alignment string, page_number_start int, page_number_restart boolean")
    tables = none("doc_id long, table_ix int, rows_count int, title_para_ix int, has_header_row boolean, width_cm double, has_grid boolean, border_color string, border_size double, has_cant_split_rows boolean, repeats_header boolean, empty_row_ix array<int>, enlarged_row_ix array<int>")
    images = none("doc_id long, image_ix int, para_ix int, width_cm double, width_px int, height_px int, extension string")
    meta = none("doc_id long, has_footnotes_part boolean, footnote_number_format string, footnote_number_restart string")
    rules = fixtures.rules(spark, {"profile_id": "a", "parameter": "figure_caption_prefix", "value": "Рисунок"}, {"profile_id": "b", "parameter": "figure_caption_prefix", "value": "Рис."})
    found = check(Blocks(p, sections, tables, images, meta), rules).select("profile_id", "parameter", "expected").collect()
    assert {tuple(r) for r in found} == {("b", "figure_caption_prefix", "Рис.")}


def test_profiles_with_byte_order_marks_and_back(spark, tmp_path):
    profile = [{"id": "p", "name": "Профиль", "rules": [{"id": "r", "category": "formatting", "target": "main_text", "parameter": "font_size", "operator": "equals", "value": 14, "modality": "mandatory", "description": "кегль"}]}]
    for encoding in ("utf-8", "utf-8-sig", "cp1251"):
        path = tmp_path / f"{encoding}.json"
        path.write_bytes(json.dumps(profile, ensure_ascii=False).encode(encoding))
        rows = blocks.read_profiles(spark, str(path)).collect()
        assert [(r.profile_id, r.parameter, r.value_num, r.description) for r in rows] == [("p", "font_size", 14.0, "кегль")], encoding
    out = str(tmp_path / "out")
    blocks.write_profiles(blocks.read_profiles(spark, str(tmp_path / "utf-8.json")), out)
    assert json.loads(spark.read.text(out).first()[0])["rules"][0]["parameter"] == "font_size"


def test_parameter_registry(spark):
    df = spark.createDataFrame([("left_margin",), ("table_header_required",), ("space_after",)], "p string")
    got = df.select(C.parameter_label("p"), C.parameter_unit("p"), C.parameter_kind("p")).collect()
    assert [tuple(r) for r in got] == [("left margin", "cm", "page"), ("table header required", None, "table"), ("space after", "pt", "text")]

