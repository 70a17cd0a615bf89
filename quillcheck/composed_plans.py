"""Queries over corrections, and over attributes that are derived from raw blocks, composed from the order tables, with SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck import composed as K
from quillcheck.composed_text import FORMS, LINES, lines
from quillcheck.functions import columns as C
from quillcheck.operators import corrections, derive, violations
from quillcheck.registry import query

#: What the rewrites of all gates make of the forms of lines; forms that stay are left out. ~ is a no-break space.
CORRECTED = {
    1: "два пробела {n}", 3: "знак, далее", 4: "скобка (тут", 5: "скобка тут)", 6: "см. рис.~{n}~а тут", 8: "А.~Б.~Иванов", 9: "дом №~{n}", 10: "закон §~{n}", 12: "длина {m}~см тут", 15: "размер {m}×{n} тут", 19: "страницы {n}–{m} тут", 20: "года {n}–{m} тут", 21: "от −{n}–{m} тут", 22: "жара {m}~°C тут", 23: "жара {m}° тут",
    24: "доля {m}~% тут", 27: "длина {m}~см. и тут", 30: "по {n}~кг, {m}~кг тут", 32: "кто — что", 34: "кто — что", 36: "пункт №~{n}", 38: "цитата <...> конец", 40: "край", 41: "он «сказал» это", 43: "тел. 8(912)345–67-89", 46: "[{n}] Иванов И.", 47: "ГОСТ Р 1.5-2012 и {m}~см", 48: "import os", 52: "тел. 8 912 345–67-89", 55: "время {n}: {m} тут", 56: "5~% г", 59: "край", 61: "почта a.b@c.ru и {m}×{n}",
}


def _line(form: str) -> str:
    return "concat('" + form.replace("~", " ").replace("{n}", "', n, '").replace("{m}", "', m, '") + "')"


_LINES = LINES.replace("{lineitem}", "lineitem").replace("SELECT doc_id, para_ix, v,", "SELECT doc_id, para_ix, v, n, m,", 1)


@query(f"WITH lines AS ({_LINES}) SELECT doc_id, para_ix, text AS old_value, CASE v {' '.join(f'WHEN {v} THEN {_line(t)}' for v, t in CORRECTED.items() if t)} END AS new_value FROM lines WHERE v IN ({', '.join(str(v) for v, t in CORRECTED.items() if t)})")
def corrected_forms(spark, sf_dir):
    """Lines of every form after the rewrites of all gates."""
    every = [p for gate, _ in corrections.REWRITES for p in gate] + ["paragraph_edge_spaces"]
    return corrections.corrected_lines(lines(spark, sf_dir), every).select("doc_id", "para_ix", "old_value", "new_value")


_TITLE = r"regexp_replace(regexp_replace(caption_title, '^[\s—–.-]+', ''), '\.+\s*$', '')"
_CAPTION = f"concat(CASE caption_kind WHEN 'figure' THEN 'Рисунок' ELSE 'Таблица' END, ' ', caption_number, ' — ', {_TITLE})"


@query(
    K._p(
        "rows AS (SELECT * FROM p WHERE (text <> '' OR has_inline_image) AND paragraph_type <> 'table_cell'), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_ix) AS k FROM rows), "
        "pictures AS (SELECT DISTINCT a.doc_id, arg_max(b.para_ix, b.k) AS para_ix FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 5 AND a.k AND b.has_inline_image WHERE a.caption_kind = 'figure' GROUP BY a.doc_id, a.para_ix) "
        f"SELECT doc_id, para_ix, 'caption_text' AS parameter, text AS old_value, {_CAPTION} AS new_value FROM p WHERE paragraph_type = 'caption' AND text <> {_CAPTION} "
        "UNION ALL SELECT doc_id, para_ix, 'keep_with_next', 'false', 'true' FROM p WHERE caption_kind = 'table' AND NOT keep_with_next UNION ALL SELECT doc_id, para_ix, 'keep_with_next', 'false', 'true' FROM p JOIN pictures USING (doc_id, para_ix) WHERE NOT keep_with_next"
    )
)
def caption_plan(spark, sf_dir):
    """Captions rewritten, and what keeps with what: table captions, and the picture within five rows above a figure caption."""
    return corrections.caption_plan(K.paragraphs(spark, sf_dir), {"figure": "Рисунок", "table": "Таблица"}).select("doc_id", "para_ix", "parameter", "old_value", "new_value")


@query(
    f"WITH s AS ({K._duck(K.SECTIONS)}) SELECT doc_id, section_ix, 'header_distance' AS parameter, '1' AS old_value, '1.25' AS new_value FROM s WHERE header_distance_cm = 1 UNION ALL SELECT doc_id, section_ix, 'page_number_area', page_number_area, 'footer' FROM s WHERE page_number_area IS DISTINCT FROM 'footer' "
    "UNION ALL SELECT doc_id, section_ix, 'first_page_number', 'true', 'false' FROM s WHERE section_ix = 0 AND first_page_has_page_number"
)
def page_plan(spark, sf_dir):
    """Distances, page numbers in the footer, and none on the first page, for the rules that ask for them."""
    rules = K.profile(spark, ("header_distance", 1.25, "page", "min"), ("footer_distance", 1.25, "page", "min"), ("page_number_area",), ("first_page_no_page_number",))
    return corrections.page_plan(K.sections(spark, sf_dir), rules).select("doc_id", "section_ix", "parameter", "old_value", "new_value")


@query(f"WITH s AS ({K._duck(K.SECTIONS)}) SELECT doc_id, section_ix, 'left_margin' AS parameter, '2' AS old_value, '3' AS new_value FROM s WHERE left_margin_cm = 2 UNION ALL SELECT doc_id, section_ix, 'right_margin', '2.5', '1.5' FROM s WHERE right_margin_cm = 2.5")
def margin_plan(spark, sf_dir):
    """Margins that go to an exact pattern."""
    rules = K.profile(spark, ("left_margin", 3.0, "page"))
    return corrections.margin_plan(K.sections(spark, sf_dir), rules, exact=(2.0, 2.0, 3.0, 1.5)).select("doc_id", "section_ix", "parameter", "old_value", "new_value")


def _cell(parameter: str, old: str, new: str, where: str) -> str:
    return f"SELECT doc_id, table_ix, para_ix, '{parameter}' AS parameter, {old} AS old_value, {new} AS new_value FROM c WHERE {where}"


@query(
    K._p(
        f"t AS ({K._duck(K.TABLES)}), c AS (SELECT * FROM p WHERE paragraph_type = 'table_cell') "
        + " UNION ALL ".join(
            [
                _cell("line_spacing", "'1.5'", "'1'", "line_spacing = 1.5"),
                _cell("first_line_indent", "CASE WHEN first_line_indent_cm = 1.25 THEN '1.25' END", "'0'", "first_line_indent_cm IS DISTINCT FROM 0"),
                _cell("left_indent", "'0.5'", "'0'", "left_indent_cm = 0.5"),
                _cell("right_indent", "'0.75'", "'0'", "right_indent_cm = 0.75"),
                _cell("alignment", "alignment", "'left'", "table_row_ix <> 0 AND alignment <> 'left'"),
                _cell("font_size", "CAST(CAST(font_size_pt AS INTEGER) AS VARCHAR)", "'12'", "font_size_pt <> 12"),
                "SELECT doc_id, table_ix, NULL, 'repeats_header', 'false', 'true' FROM t WHERE rows_count > 8 AND NOT repeats_header",
            ]
        )
    )
)
def table_plan(spark, sf_dir):
    """Cells and long tables, for the rules that ask for them."""
    rules = K.profile(spark, ("table_text_spacing_indent",), ("table_text_font_size", 12.0), ("table_repeat_header",))
    return corrections.table_plan(K.paragraphs(spark, sf_dir), K.tables(spark, sf_dir), rules).select("doc_id", "table_ix", "para_ix", "parameter", "old_value", "new_value")


_MODAL_NUMBERED = "coalesce(modal IN ('number_bracket', 'number_dot', 'letter_bracket', 'letter_dot'), false)"


@query(
    K._l(
        f"{K._ISLANDS}, {K._main('list_marker_type', 'modal', 'true', 'para_ix', 'i', 'doc_id, list_ix')}, j AS (SELECT *, {_MODAL_NUMBERED} AS numbered, coalesce(before, '') LIKE '%:' AND NOT {_MODAL_NUMBERED} AS listed FROM i LEFT JOIN modal USING (doc_id, list_ix)), "
        "k AS (SELECT *, CASE WHEN listed THEN concat(lower(body[1]), body[2:]) WHEN numbered AND modal LIKE '%_dot' THEN concat(upper(body[1]), body[2:]) ELSE body END AS cased FROM j), "
        "e AS (SELECT *, concat_ws(' ', CASE WHEN NOT numbered THEN '—' WHEN modal = 'number_dot' THEN concat(place, '.') WHEN modal = 'number_bracket' THEN concat(place, ')') ELSE list_marker END, CASE WHEN listed THEN concat(regexp_replace(cased, '[;.,]+$', ''), CASE WHEN place = size THEN '.' ELSE ';' END) ELSE cased END) AS new_value FROM k) "
        "SELECT doc_id, para_ix, text AS old_value, new_value FROM e WHERE new_value <> text"
    )
)
def list_plan(spark, sf_dir):
    """List items with the marker of their list, case and end by the text before it."""
    return corrections.list_plan(K.lists(spark, sf_dir)).where("parameter = 'list_text'").select("doc_id", "para_ix", "old_value", "new_value")


_SIGNED = "g AS (SELECT *, coalesce(paragraph_type = 'list_item' OR is_automatic_list OR list_marker_type IS NOT NULL, false) AS item FROM p), isl AS (SELECT *, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_ix) AS list_ix FROM g), i AS (SELECT *, {'f': CAST(first_line_indent_cm AS DOUBLE), 'l': CAST(left_indent_cm AS DOUBLE)} AS own FROM isl WHERE item)"
_TEXT = "CASE {v} WHEN 1.25 THEN '1.25' WHEN 0.5 THEN '0.5' WHEN 0.75 THEN '0.75' ELSE '0' END"


@query(
    K._l(
        f"{_SIGNED}, {K._main('own', 'most', 'true', 'para_ix', 'i', 'doc_id, list_ix')}, j AS (SELECT * FROM i JOIN most USING (doc_id, list_ix)), "
        "c AS (SELECT doc_id, para_ix, 'exact' AS profile_id, 'first_line_indent' AS parameter, own.f AS o, 0.75 AS n FROM j UNION ALL SELECT doc_id, para_ix, 'exact', 'left_indent', own.l, most.l FROM j UNION ALL SELECT doc_id, para_ix, 'same', 'first_line_indent', own.f, most.f FROM j UNION ALL SELECT doc_id, para_ix, 'same', 'left_indent', own.l, most.l FROM j) "
        f"SELECT doc_id, para_ix, profile_id, parameter, {_TEXT.format(v='o')} AS old_value, {_TEXT.format(v='n')} AS new_value FROM c WHERE o <> n"
    )
)
def list_indent_plan(spark, sf_dir):
    """Indents of list items for two profiles: one with an exact first-line indent for lists like main text, one that wants each list alike."""
    first = K.profile(spark, ("first_line_indent", 0.75, "main_text"), ("list_indent_equals_main_text",)).withColumns({"profile_id": F.lit("exact"), "rule_id": F.when(F.col("parameter") == "list_indent_equals_main_text", F.col("parameter")).otherwise(F.col("rule_id"))})
    second = K.profile(spark, ("list_marker_consistency",)).withColumn("profile_id", F.lit("same"))
    return corrections.list_indent_plan(K.lists(spark, sf_dir), first.unionByName(second))


@query(
    K._p(
        f"{K._main('font_size_pt', 'main0')}, main AS (SELECT doc_id, least(greatest(main0, 12), 14) AS main FROM main0), {K._SIZES}, h AS (SELECT * FROM p LEFT JOIN sizes USING (doc_id, heading_level) WHERE paragraph_type = 'heading') "
        "SELECT doc_id, para_ix, 'font_size' AS parameter, CAST(CAST(font_size_pt AS INTEGER) AS VARCHAR) AS old_value, CASE heading_level WHEN 1 THEN '16' ELSE '14' END AS new_value FROM h WHERE font_size_pt <> CASE heading_level WHEN 1 THEN 16 ELSE 14 END "
        "UNION ALL SELECT doc_id, para_ix, 'alignment', alignment, 'center' FROM h WHERE is_structural_heading AND alignment <> 'center' UNION ALL SELECT doc_id, para_ix, 'bold', 'false', 'true' FROM h WHERE NOT bold "
        "UNION ALL SELECT doc_id, para_ix, 'heading_font_size_hierarchy', CAST(CAST(font_size_pt AS INTEGER) AS VARCHAR), CAST(CAST(expected AS INTEGER) AS VARCHAR) FROM h WHERE expected IS NOT NULL AND font_size_pt <> expected"
    )
)
def heading_plan(spark, sf_dir):
    """Headings: the most special rule of each value, and sizes by level around the main size inside its limits."""
    rules = K.profile(spark, ("font_size", 16.0, "heading_level_1"), ("font_size", 14.0, "heading"), ("alignment", "center", "structural_heading"), ("bold", True, "heading"), ("heading_font_size_hierarchy",), ("font_size", 12.0, "main_text", "min"), ("font_size", 14.0, "main_text", "max"))
    p = K.paragraphs(spark, sf_dir).withColumn("logical_section", F.lit("main_part"))
    return corrections.heading_plan(p, rules).select("doc_id", "para_ix", "parameter", "old_value", "new_value")


@query(K._p("b AS (SELECT *, min(CASE WHEN text <> '' THEN para_ix END) OVER w AS lo, max(CASE WHEN text <> '' THEN para_ix END) OVER w AS hi FROM p WINDOW w AS (PARTITION BY doc_id)) SELECT doc_id, para_ix, text FROM b WHERE NOT coalesce(text = '' AND para_ix > lo AND para_ix < hi, false)"))
def without_empty_paragraphs(spark, sf_dir):
    """Documents without blank rows between their first and last text."""
    return corrections.without_empty(K.paragraphs(spark, sf_dir)).select("doc_id", "para_ix", "text")


@query(K._t("heads AS (SELECT doc_id, para_ix FROM p WHERE m = 0), toc AS (SELECT doc_id, para_ix FROM p WHERE logical_section = 'toc') SELECT doc_id, para_ix FROM heads UNION SELECT doc_id, para_ix FROM toc"))
def protected_rows(spark, sf_dir):
    """Rows that corrections leave alone."""
    p = K._of(spark, sf_dir, K.THESIS)
    return corrections.protected(p, p.where("m = 0"))


#: Raw attributes of paragraphs and their styles, some of which are based on others.
STYLES = """
SELECT doc_id, style_id, CASE style_id WHEN 'S1' THEN 'S2' WHEN 'S2' THEN 'S3' WHEN 'S3' THEN CASE WHEN x % 2 = 0 THEN 'Normal' ELSE 'S1' END END AS based_on, CASE WHEN style_id = 'Normal' AND x % 3 > 0 THEN 'both' WHEN style_id = 'S3' AND x % 4 = 0 THEN 'center' END AS alignment, CASE style_id WHEN 'Normal' THEN 'Times' WHEN 'S2' THEN 'Arial' END AS font_family,
  CASE style_id WHEN 'Normal' THEN 14.0 WHEN 'S1' THEN 12.0 END AS font_size_pt, CASE WHEN style_id = 'S1' THEN x % 2 = 0 END AS bold, CASE WHEN style_id = 'Normal' THEN x % 5 = 0 END AS italic, CASE WHEN style_id = 'S2' THEN 1.25 END AS first_line_indent_cm, CASE WHEN style_id = 'Normal' THEN 1.5 END AS line_spacing, CASE WHEN style_id = 'S1' THEN 6.0 END AS space_before_pt, CASE WHEN style_id = 'S3' THEN true END AS keep_with_next
FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, max(l_partkey) AS x FROM {lineitem} GROUP BY 1) AS docs, (SELECT 'Normal' AS style_id UNION ALL SELECT 'S1' UNION ALL SELECT 'S2' UNION ALL SELECT 'S3') AS names"""
RAW = f"WITH base AS ({K.BASE}) SELECT doc_id, para_ix, CASE b % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' ELSE 'S3' END AS style_id, CASE WHEN a % 4 = 0 THEN 'end' END AS alignment, CASE WHEN a % 6 = 0 THEN 16.0 END AS run_size, CASE WHEN a % 5 = 0 THEN true END AS run_bold, CASE WHEN q > 40 THEN 0.5 END AS first_line_indent_cm, CASE WHEN q < 10 THEN 2.0 END AS line_spacing, CASE WHEN q < 5 THEN 'exact' ELSE 'auto' END AS line_rule, CASE WHEN t > 0.06 THEN 3.0 END AS space_before_pt FROM base"


@query(
    f"""WITH st AS MATERIALIZED ({STYLES.replace("{lineitem}", "lineitem")}), raw AS MATERIALIZED ({K._duck(RAW)}), p AS (SELECT r.*, s.*, n.* FROM raw r LEFT JOIN (SELECT doc_id AS sd, style_id AS sid, alignment AS s_alignment, font_family AS s_family, font_size_pt AS s_size, bold AS s_bold, italic AS s_italic, first_line_indent_cm AS s_indent, line_spacing AS s_spacing, space_before_pt AS s_before, keep_with_next AS s_keep, based_on FROM st) s ON r.doc_id = sd AND r.style_id = sid LEFT JOIN (SELECT doc_id AS nd, alignment AS n_alignment, italic AS n_italic FROM st WHERE style_id = 'Normal') n ON r.doc_id = nd),
third AS MATERIALIZED (SELECT doc_id AS td, alignment AS t_alignment, based_on AS t_based FROM st WHERE style_id = 'S3')
SELECT doc_id, para_ix, CASE WHEN alignment = 'end' THEN 'right' ELSE coalesce(CASE WHEN style_id <> 'Normal' THEN t_alignment END, CASE n_alignment WHEN 'both' THEN 'justify' END, 'left') END AS alignment, coalesce(CASE WHEN style_id = 'S2' THEN 'Arial' END, 'Times') AS font_family, CAST(coalesce(run_size, s_size, 14.0) AS DOUBLE) AS font_size_pt, coalesce(run_bold, s_bold, false) AS bold, coalesce(n_italic, false) AS italic, CAST(coalesce(first_line_indent_cm, s_indent, 0.0) AS DOUBLE) AS first_line_indent_cm,
  CAST(coalesce(CASE WHEN line_rule = 'auto' THEN line_spacing END, s_spacing, 1.5) AS DOUBLE) AS line_spacing, CAST(coalesce(space_before_pt, s_before) AS DOUBLE) AS space_before_pt, s_keep AS keep_with_next FROM p JOIN third ON doc_id = td"""
)
def effective_attributes(spark, sf_dir):
    """Paragraphs with the values that hold: their own, their style's, those of the styles it is based on, those of Normal."""
    # a chain that never meets an alignment ends in Normal's, or left; names of alignments are mapped
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    styles = spark.sql(STYLES, lineitem=li)
    for c, k in {"left_indent_cm": "double", "right_indent_cm": "double", "space_after_pt": "double", "keep_together": "boolean", "page_break_before": "boolean"}.items():
        styles = styles.withColumn(c, F.lit(None).cast(k))
    styles = styles.withColumns({c: F.col(c).cast("double") for c in ("font_size_pt", "first_line_indent_cm", "line_spacing", "space_before_pt")}).withColumn("alignment", C.mapped("alignment", derive.ALIGNMENTS))
    run = F.struct(F.lit("текст").alias("text"), F.lit(None).cast("string").alias("font_family"), F.col("run_size").cast("double").alias("font_size_pt"), F.col("run_bold").alias("bold"), F.lit(None).cast("boolean").alias("italic"))
    raw = spark.sql(RAW, lineitem=li).withColumn("runs", F.array(run)).withColumns({"left_indent_cm": F.lit(None).cast("double"), "right_indent_cm": F.lit(None).cast("double"), "space_after_pt": F.lit(None).cast("double"), "keep_with_next": F.lit(None).cast("boolean"), "keep_together": F.lit(None).cast("boolean"), "page_break_before": F.lit(None).cast("boolean")})
    raw = raw.withColumns({c: F.col(c).cast("double") for c in ("first_line_indent_cm", "line_spacing", "space_before_pt")})
    return derive.paragraph_effects(raw, styles).select("doc_id", "para_ix", "alignment", "font_family", "font_size_pt", "bold", "italic", "first_line_indent_cm", "line_spacing", "space_before_pt", "keep_with_next")


#: First pages of theses: title pages, introductions and numbered headings.
OPENINGS = """
SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS para_ix, CAST((o_orderkey * 7 + o_custkey) % 9 AS INT) AS m, CASE CAST((o_orderkey * 7 + o_custkey) % 9 AS INT) WHEN 0 THEN 'Министерство образования' WHEN 1 THEN 'Университет' WHEN 2 THEN 'Студент Иванов' WHEN 3 THEN 'Москва 2024' WHEN 4 THEN 'Введение' WHEN 5 THEN 'Обычный текст.' WHEN 6 THEN 'Кафедра' WHEN 7 THEN '1 Обзор' ELSE 'Приложение А' END AS text
FROM {orders}"""
_TITLES = f"""o AS ({OPENINGS.replace("{orders}", "orders")}), n AS (SELECT *, row_number() OVER w AS k, bool_or(m IN (4, 7)) OVER w AS stopped FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY para_ix)), lead AS (SELECT *, k <= 40 AND NOT stopped AS front FROM n),
score AS (SELECT doc_id, coalesce(count(DISTINCT CASE WHEN m IN (0, 1, 2, 6) THEN m END) FILTER (front), 0) + 2 * coalesce(bool_or(m = 3) FILTER (front), false)::INT >= 3 AS titled FROM lead GROUP BY doc_id),
typed AS (SELECT *, front AND titled AS title, CASE WHEN front AND titled THEN 'title_page' WHEN m IN (4, 7, 8) THEN 'heading' ELSE 'main_text' END AS paragraph_type FROM lead JOIN score USING (doc_id))"""


@query(f"WITH {_TITLES} SELECT doc_id, para_ix, paragraph_type, CASE WHEN paragraph_type = 'heading' THEN 1 END AS heading_level, CASE WHEN title THEN 'title_page' ELSE coalesce(last_value(CASE WHEN paragraph_type = 'heading' THEN CASE m WHEN 4 THEN 'introduction' WHEN 7 THEN 'main_part' ELSE 'appendix' END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_ix), 'other') END AS logical_section FROM typed")
def title_pages(spark, sf_dir):
    """Title pages, structural headings and the logical section of every row."""
    rows = spark.sql(OPENINGS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).select("doc_id", "para_ix", "text")
    return derive.prepared(rows).select("doc_id", "para_ix", "paragraph_type", "heading_level", "logical_section")


def _orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


#: One row an order: raw values of blocks.
FACTS = """
SELECT o_custkey AS doc_id, o_orderkey AS ix, CASE o_orderkey % 6 WHEN 0 THEN 'Рис. 2.1 — Схема' WHEN 1 THEN 'Таблица 3. Данные' WHEN 2 THEN 'рисунок 4' WHEN 3 THEN 'E = mc (1.2)' WHEN 4 THEN 'Заключение.' ELSE 'Рисунки тут' END AS text, CAST(o_orderkey % 3 AS INT) AS equations, CAST(o_orderkey % 2 AS INT) AS images,
  CASE o_orderkey % 4 WHEN 0 THEN 'a/b.PNG' WHEN 1 THEN 'x.tar.Jpg' WHEN 2 THEN 'none' END AS name, CAST(o_orderkey * 360000 AS BIGINT) AS emu, CASE o_orderkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'CENTER' ELSE 'odd' END AS alignment, CASE o_orderkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'rgb' ELSE 'theme' END AS kind, 'ff00aa' AS color
FROM {orders}"""


@query(
    f"""WITH f AS ({FACTS.replace("{orders}", "orders")}) SELECT ix, CASE ix % 6 WHEN 0 THEN 'Рис.' WHEN 1 THEN 'Таблица' WHEN 2 THEN 'рисунок' END AS prefix, CASE ix % 6 WHEN 0 THEN '2.1' WHEN 1 THEN '3' WHEN 2 THEN '4' END AS number, CASE ix % 6 WHEN 0 THEN '— Схема' WHEN 1 THEN 'Данные' WHEN 2 THEN '' END AS title, CASE ix % 6 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' END AS caption_kind,
  equations > 0 AS has_equation, CASE WHEN ix % 6 = 3 THEN '(1.2)' END AS equation_number, equations > 0 AND (ix % 6 = 3 OR length(text) <= 8) AS is_standalone_equation, images > 0 AND ix % 6 = 3 AS has_formula_like_image, CASE ix % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' END AS extension, CAST(ix AS DOUBLE) AS cm, round_even(emu / 12700.0::DOUBLE, 3) AS pt, CASE ix % 3 WHEN 0 THEN 'justify' WHEN 1 THEN 'center' ELSE 'odd' END AS alignment,
  CASE kind WHEN 'auto' THEN '000000' WHEN 'rgb' THEN 'FF00AA' END AS color, ix % 6 = 4 AS structural FROM f"""
)
def block_facts(spark, sf_dir):
    """Captions, equations, file endings, lengths, alignments and colours from raw values."""
    df = _orders(spark, sf_dir, FACTS)
    caption, equation = C.caption("text"), C.equation_flags("text", "equations", "images")
    return df.select("ix", *(caption[c].alias(n) for c, n in (("prefix", "prefix"), ("number", "number"), ("title", "title"), ("kind", "caption_kind"))), *(equation[c].alias(c) for c in ("has_equation", "equation_number", "is_standalone_equation", "has_formula_like_image")), C.extension("name").alias("extension"), C.emu_to_cm("emu").alias("cm"), C.emu_to_pt("emu").alias("pt"), C.mapped("alignment", derive.ALIGNMENTS).alias("alignment"), C.run_color("color", "kind").alias("color"), C.is_structural_heading("text").alias("structural"))


@query("SELECT o_custkey AS doc_id, CASE o_custkey % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'lowerRoman' END AS footnote_number_format, CASE WHEN o_custkey % 2 = 0 THEN 'eachPage' END AS footnote_number_restart FROM orders GROUP BY o_custkey")
def footnote_settings(spark, sf_dir):
    """Number format and restart of footnotes from the settings text."""
    sql = """SELECT o_custkey AS doc_id, max(concat('<w:a/><w:numFmt w:val="x"/><w:footnotePr>', CASE o_custkey % 3 WHEN 0 THEN '<w:numFmt w:val="decimal"/>' WHEN 1 THEN '<w:numFmt w:val="lowerRoman"/>' ELSE '' END, CASE WHEN o_custkey % 2 = 0 THEN '<w:numRestart w:val="eachPage"/>' ELSE '' END, '</w:footnotePr>')) AS settings FROM {orders} GROUP BY o_custkey"""
    return derive.footnote_settings(_orders(spark, sf_dir, sql))


@query("WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS ix, o_orderkey % 2 = 0 AS body FROM orders), last AS (SELECT doc_id, max(ix) FILTER (body) AS last FROM o GROUP BY doc_id) SELECT doc_id, CAST(ix AS INTEGER) AS para_ix, CAST(NULL AS VARCHAR) AS origin_type FROM o WHERE body UNION ALL SELECT doc_id, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS INTEGER), 'footnote' FROM o JOIN last USING (doc_id) WHERE NOT body AND ix % 5 <> 0")
def footnote_rows(spark, sf_dir):
    """Footnotes with text as rows after the last paragraph."""
    rows = _orders(spark, sf_dir, "SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS para_ix, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE 'сноска ' END AS text, o_orderkey % 2 = 0 AS body FROM {orders}")
    out = derive.with_footnotes(rows.where("body").drop("body"), rows.where("not body").select("doc_id", F.col("para_ix").alias("footnote_ix"), "text"))
    return out.select("doc_id", "para_ix", "origin_type")


@query("SELECT o_orderkey AS para_ix, o_orderkey % 4 <> 0 AS is_automatic_list, CASE o_orderkey % 4 WHEN 1 THEN '%1)' WHEN 2 THEN '—' END AS automatic_marker, CASE o_orderkey % 4 WHEN 1 THEN 'number_bracket' WHEN 2 THEN 'dash' WHEN 3 THEN 'number_dot' END AS automatic_marker_type FROM orders")
def automatic_markers(spark, sf_dir):
    """Markers of automatic lists through their numbering and level; the chain of every fourth order is broken."""
    rows = _orders(spark, sf_dir, "SELECT o_custkey AS doc_id, o_orderkey AS para_ix, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS INT) END AS num_id, 0 AS ilvl FROM {orders}")
    numbers = _orders(spark, sf_dir, "SELECT doc_id, num_id, num_id + 10 AS abstract_num_id FROM (SELECT DISTINCT o_custkey AS doc_id, CAST(o_orderkey % 4 AS INT) AS num_id FROM {orders} WHERE o_orderkey % 4 IN (1, 2)) AS x")
    levels = numbers.select("doc_id", "abstract_num_id", F.lit(0).alias("ilvl"), F.when(F.col("num_id") == 1, "decimal").otherwise("bullet").alias("level_format"), F.when(F.col("num_id") == 1, "%1)").otherwise("—").alias("level_text"))
    return derive.automatic_markers(rows, numbers, levels).select("para_ix", "is_automatic_list", "automatic_marker", "automatic_marker_type")


_CONTEXT = "SELECT o_custkey AS doc_id, o_orderkey AS block_ix, o_orderkey % 5 = 0 AS is_table, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS INT) END AS para_ix, CASE WHEN o_orderkey % 7 = 1 AND o_orderkey % 5 <> 0 THEN 'table' END AS caption_kind, CASE WHEN o_orderkey % 11 = 3 AND o_orderkey % 5 <> 0 THEN 'Продолжение таблицы 2' ELSE 'текст' END AS text FROM {orders}"


@query(
    f"""WITH b AS ({_CONTEXT.replace("{orders}", "orders")}), g AS (SELECT *, coalesce(sum(is_table::INT) OVER (PARTITION BY doc_id ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, last_value(para_ix IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
t AS (SELECT *, max(CASE WHEN caption_kind = 'table' OR text LIKE 'Продолжение%' THEN para_ix END) OVER (PARTITION BY doc_id, g ORDER BY block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title FROM g) SELECT doc_id, CAST(g AS INTEGER) AS table_ix, title AS title_para_ix, before AS paragraph_before_ix FROM t WHERE is_table"""
)
def table_contexts(spark, sf_dir):
    """The title of each table and the paragraph before it."""
    return derive.table_contexts(_orders(spark, sf_dir, _CONTEXT))


@query("SELECT o_custkey AS doc_id, CAST(o_orderkey % 4 AS INTEGER) AS para_ix, CAST(count(*) AS INTEGER) AS image_count FROM orders GROUP BY ALL")
def image_counts(spark, sf_dir):
    """Images of each paragraph."""
    drawings = _orders(spark, sf_dir, "SELECT o_custkey AS doc_id, CAST(o_orderkey % 4 AS INT) AS para_ix, CAST(o_orderkey AS STRING) AS rid FROM {orders}")
    return derive.images_in_paragraphs(drawings)[0]


_PARTS = "SELECT o_custkey AS doc_id, 0 AS section_ix, CASE o_orderkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'first_header' ELSE 'first_footer' END AS part, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN ' page ' END AS instr, CASE WHEN o_orderkey % 2 = 0 THEN 'center' ELSE 'right' END AS alignment, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('т', CAST(o_orderkey % 10 AS STRING), ' ') END AS text FROM {orders}"
_PAGES = "SELECT doc_id, 0 AS section_ix, 7560000 AS page_width_emu, CASE WHEN doc_id % 2 = 0 THEN 10692000 ELSE 5346000 END AS page_height_emu, 720000 AS top_margin_emu, 720000 AS bottom_margin_emu, 1080000 AS left_margin_emu, 540000 AS right_margin_emu, 450000 AS header_distance_emu, 450000 AS footer_distance_emu, doc_id % 3 = 0 AS different_first_page_header_footer, CASE WHEN doc_id % 5 = 0 THEN 3 END AS page_number_start FROM (SELECT DISTINCT o_custkey AS doc_id FROM {orders}) AS d"


@query(
    f"""WITH s AS ({_PAGES.replace("{orders}", "orders")}), x AS ({_PARTS.replace("{orders}", "orders")}), f AS (SELECT doc_id, bool_or(part = 'header' AND instr IS NOT NULL) AS h, bool_or(part = 'footer' AND instr IS NOT NULL) AS f, bool_or(part = 'first_header' AND instr IS NOT NULL) AS fh, bool_or(part = 'first_footer' AND instr IS NOT NULL) AS ff, arg_min(alignment, pos) FILTER (part = 'header' AND instr IS NOT NULL) AS ha, arg_min(alignment, pos) FILTER (part = 'footer' AND instr IS NOT NULL) AS fa, coalesce(string_agg(trim(text), chr(10) ORDER BY pos) FILTER (part = 'header' AND text <> ''), '') AS header_text FROM x GROUP BY doc_id)
SELECT doc_id, 21.0::DOUBLE AS page_width_cm, CASE WHEN doc_id % 2 = 0 THEN 'A4' ELSE 'A5' END AS page_format, CASE WHEN doc_id % 2 = 0 THEN 'portrait' ELSE 'landscape' END AS page_orientation, h OR f AS has_page_number, CASE WHEN f THEN 'footer' WHEN h THEN 'header' END AS page_number_area, CASE WHEN f THEN fa WHEN h THEN ha END AS page_number_alignment, CASE WHEN different_first_page_header_footer THEN fh OR ff ELSE f OR h END AS first_page_has_page_number, false AS page_number_restart, header_text, header_text <> '' AS has_header FROM s JOIN f USING (doc_id)"""
)
def section_facts(spark, sf_dir):
    """Sections from lengths, parts and fields."""
    found = derive.section_facts(_orders(spark, sf_dir, _PAGES), _orders(spark, sf_dir, _PARTS))
    return found.select("doc_id", "page_width_cm", "page_format", "page_orientation", "has_page_number", "page_number_area", "page_number_alignment", "first_page_has_page_number", "page_number_restart", "header_text", "has_header")


_CELLS = "SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS INT) AS row_ix, CAST(floor(o_orderkey / 3.0) % 4 AS INT) AS col_ix, max(o_orderkey) AS x FROM {orders} GROUP BY 1, 2, 3"


@query(
    f"""WITH c AS ({_CELLS.replace("{orders}", "orders")}), m AS (SELECT doc_id, row_ix, col_ix // 2 AS cell, min(col_ix) AS col_ix, arg_min(x, col_ix) AS x FROM c GROUP BY ALL), r AS (SELECT doc_id, row_ix, bool_and(x % 5 = 0) AS empty, arg_min(x, col_ix) AS x, max(col_ix) AS last FROM m GROUP BY ALL), first AS (SELECT doc_id, arg_min(x, row_ix) AS x FROM r GROUP BY doc_id)
SELECT doc_id, CAST(max(row_ix) + 1 AS INTEGER) AS rows_count, CAST(max(last) + 1 AS INTEGER) AS columns_count, count(*) FILTER (empty) AS n_empty, max(first.x % 4 <> 0) AS has_grid, max(CASE WHEN first.x % 4 <> 0 THEN CASE WHEN first.x % 2 = 0 THEN 'auto' ELSE 'red' END END) AS border_color, max(CASE WHEN first.x % 4 <> 0 THEN (4 + first.x % 3) / 8.0 END)::DOUBLE AS border_size FROM r JOIN first USING (doc_id) GROUP BY doc_id"""
)
def merged_tables(spark, sf_dir):
    """Tables whose cells span two columns: sizes, empty rows, borders of the first cell."""
    cells = _orders(spark, sf_dir, _CELLS)
    border = F.struct(F.when(F.col("x") % 4 == 0, "nil").otherwise("single").alias("val"), F.when(F.col("x") % 2 == 0, "auto").otherwise("red").alias("color"), (4 + F.col("x") % 3).alias("size"))
    cells = cells.select("doc_id", F.lit(0).alias("table_ix"), "row_ix", "col_ix", F.expr("cast(col_ix div 2 as int)").alias("cell_id"), F.when(F.col("x") % 5 == 0, "").otherwise("x").alias("text"), F.lit(300).alias("row_height_twips"), F.lit(False).alias("cant_split"), F.lit(False).alias("repeats_header"), F.array(border).alias("borders"))
    out = derive.table_facts(cells)
    return out.select("doc_id", "rows_count", "columns_count", F.size("empty_row_ix").cast("long").alias("n_empty"), "has_grid", "border_color", "border_size")

