"""A thesis of a few paragraphs with known faults, and its rules."""

from pyspark.sql import functions as F

RUN = "struct<run_ix:int,text:string,style_name:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,double_strike:boolean,small_caps:boolean,all_caps:boolean,font_size_pt:double,font_color:string,character_spacing:int,subscript:boolean,superscript:boolean,has_character_style:boolean,has_direct_formatting:boolean>"
COLUMNS = {
    "doc_id": "long", "para_ix": "int", "text": "string", "style_name": "string", "font_family": "string", "font_size_pt": "double", "bold": "boolean", "italic": "boolean", "runs": f"array<{RUN}>", "alignment": "string", "first_line_indent_cm": "double", "left_indent_cm": "double", "right_indent_cm": "double", "line_spacing": "double",
    "space_before_pt": "double", "space_after_pt": "double", "keep_with_next": "boolean", "keep_together": "boolean", "page_break_before": "boolean", "has_line_break": "boolean", "has_page_break": "boolean", "has_inline_image": "boolean", "image_count": "int", "table_ix": "int", "table_row_ix": "int", "table_col_ix": "int",
    "is_automatic_list": "boolean", "has_equation": "boolean", "has_formula_like_image": "boolean", "is_standalone_equation": "boolean", "origin_type": "string",
}
DEFAULTS = {"style_name": "Normal", "font_family": "Times New Roman", "font_size_pt": 14.0, "bold": False, "italic": False, "alignment": "justify", "first_line_indent_cm": 1.25, "left_indent_cm": 0.0, "right_indent_cm": 0.0, "line_spacing": 1.5, "space_before_pt": 0.0, "space_after_pt": 0.0}


def run(i, text, size=14.0, **more):
    return {"run_ix": i, "text": text, "font_size_pt": size, "font_color": "000000", **more}


def paragraphs(spark, rows):
    """rows: dicts with at least text; doc_id 1 and running numbers where absent."""
    made = []
    for i, r in enumerate(rows):
        r = {"doc_id": 1, "para_ix": i, **DEFAULTS, **r}
        r.setdefault("runs", [run(0, r["text"], r["font_size_pt"])])
        runs = [tuple(x.get(f.split(":")[0]) for f in RUN[7:-1].split(",")) for x in r["runs"]]
        made.append(tuple(runs if c == "runs" else r.get(c) for c in COLUMNS))
    return spark.createDataFrame(made, ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))


def rules(spark, *rows):
    """rows: dicts with parameter; equals, mandatory and formatting by default."""
    made = []
    for i, r in enumerate(rows):
        v = r.get("value")
        made.append((r.get("profile_id", "p"), r.get("id", f"r{i}"), i, r.get("category", "formatting"), r.get("target", "document"), r["parameter"], r.get("operator", "equals"), r.get("unit"), r.get("modality", "mandatory"), r.get("section", "1"), r.get("strategy"), r.get("condition"), True,
                     float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, v if isinstance(v, str) else None, v if isinstance(v, bool) else None, [str(x) for x in v] if isinstance(v, list) else None))
    df = spark.createDataFrame(made, "profile_id string, rule_id string, ordinal int, category string, target string, parameter string, operator string, unit string, modality string, source_section string, strategy string, cond string, enabled boolean, value_num double, value_str string, value_bool boolean, value_list array<string>")
    return df.withColumn("consistency_strategy", F.expr("parse_json(strategy)")).withColumn("condition", F.expr("parse_json(cond)")).drop("strategy", "cond")


THESIS = [
    {"text": "Министерство образования"}, {"text": "Университет"}, {"text": "Студент Иванов"}, {"text": "Москва 2024"},
    {"text": "Введение", "style_name": "Heading 1", "font_size_pt": 16.0, "bold": True, "alignment": "center", "first_line_indent_cm": 0.0, "page_break_before": True, "space_before_pt": 12.0, "space_after_pt": 6.0},
    {"text": "Для достижения цели необходимо решить следующие задачи:"},
    {"text": "— изучить литературу;"}, {"text": "— разработка модели;"}, {"text": "- Проверить."},
    {"text": "Текст  с двумя пробелами , как на рис. 1 и 5-7 страниц."},
    {"text": "1 обзор", "style_name": "Heading 1", "font_size_pt": 14.0, "bold": True, "space_before_pt": 0.0, "space_after_pt": 6.0},
    {"text": "Обычный текст в разделе.", "font_size_pt": 12.0},
    {"text": "Рисунок 1 — схема.", "alignment": "center", "first_line_indent_cm": 0.0, "font_size_pt": 12.0},
    {"text": "См. табл. 2 далее.", "alignment": "left"},
    {"text": "Таблица 3 — Данные", "alignment": "left", "first_line_indent_cm": 0.0},
    {"text": "Заключение", "style_name": "Heading 1", "font_size_pt": 16.0, "bold": True, "alignment": "center", "first_line_indent_cm": 0.0, "page_break_before": True, "space_before_pt": 12.0, "space_after_pt": 6.0},
    {"text": "В будущем планируется продолжить."},
    {"text": "Список литературы", "style_name": "Heading 1", "font_size_pt": 16.0, "bold": True, "alignment": "center", "first_line_indent_cm": 0.0, "page_break_before": True, "space_before_pt": 12.0, "space_after_pt": 6.0},
    {"text": "1. Петров П. Книга. М., 2001."},
    {"text": "ячейка", "origin_type": "table_cell", "table_ix": 0, "table_row_ix": 0, "table_col_ix": 0, "line_spacing": 1.0, "first_line_indent_cm": 0.0},
    {"text": "5", "origin_type": "table_cell", "table_ix": 0, "table_row_ix": 1, "table_col_ix": 0, "line_spacing": 1.5, "alignment": "center"},
]
