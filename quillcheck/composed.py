"""Queries over collections of blocks that are composed from the order tables, with the rules' SQL to hold them against.

BASE makes documents of up to 24 paragraphs of orders and their lines; both engines read it. What a
paragraph is, says and looks like follows from the numbers of its line, so every rule has rows that
break it and rows that do not, and the collection grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.operators import documents, formatting, objects, typography
from quillcheck.plans.check import Blocks, findings_of, written
from quillcheck.registry import query
from quillcheck.sources.staging import dealt

BASE = """
SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, CAST((l_orderkey % 3) * 8 + l_linenumber AS INT) AS para_ix, max(l_partkey) AS a, max(l_suppkey) AS b, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, max(l_returnflag) AS rf, max(l_linestatus) AS ls
FROM {lineitem} GROUP BY 1, 2"""

_BOLD = "CASE WHEN k <= 1 THEN ls = 'F' ELSE b % 11 = 0 END"
PARAGRAPHS = f"""
WITH base AS ({BASE}), kinds AS (SELECT *, CAST(a % 12 AS INT) AS k, CAST(b % 7 + 1 AS STRING) AS n FROM base),
named AS (SELECT *, CASE WHEN k <= 1 THEN 'heading' WHEN k IN (2, 3) THEN 'caption' WHEN k = 4 THEN 'list_item' WHEN k = 5 THEN 'table_cell' WHEN k = 6 THEN 'empty' WHEN k = 7 THEN 'footnote' ELSE 'main_text' END AS paragraph_type,
  CASE WHEN k = 2 THEN 'figure' WHEN k = 3 THEN 'table' END AS caption_kind, CASE WHEN k IN (2, 3) THEN n END AS caption_number,
  CASE WHEN k = 2 AND b % 3 = 0 THEN 'Рис.' WHEN k = 2 THEN 'Рисунок' WHEN k = 3 AND b % 4 = 0 THEN 'Табл.' WHEN k = 3 THEN 'Таблица' END AS caption_prefix,
  CASE WHEN k IN (2, 3) THEN CASE WHEN a % 5 = 0 THEN 'схема.' WHEN a % 5 = 1 THEN 'Схема.' WHEN a % 5 = 2 THEN 'график' ELSE 'График' END END AS caption_title,
  CASE WHEN b % 3 = 0 THEN ' — ' WHEN b % 3 = 1 THEN '. ' ELSE ' ' END AS sep FROM kinds)
SELECT doc_id, para_ix, a, b, q, paragraph_type, caption_kind, caption_number, caption_prefix, caption_title,
  CASE WHEN k <= 1 THEN CASE b % 8 WHEN 0 THEN '1. Обзор литературы' WHEN 1 THEN '1 обзор' WHEN 2 THEN 'ВВЕДЕНИЕ В ТЕМУ' WHEN 3 THEN '2.1. Method' WHEN 4 THEN 'Заключение' WHEN 5 THEN '3.2 Итоги' WHEN 6 THEN 'Введение' ELSE 'Список литературы' END
    WHEN k = 2 THEN concat(caption_prefix, ' ', n, sep, caption_title) WHEN k = 3 AND b % 10 = 9 THEN concat('Продолжение таблицы ', n) WHEN k = 3 THEN concat(caption_prefix, ' ', n, sep, caption_title)
    WHEN k = 4 THEN CASE b % 5 WHEN 0 THEN '— изучить;' WHEN 1 THEN '- Проверить.' WHEN 2 THEN '1) собрать' WHEN 3 THEN '2. Описать' ELSE '• итог;' END WHEN k = 5 THEN CASE WHEN b % 4 = 0 THEN '—' ELSE n END WHEN k = 6 THEN '' WHEN k = 7 THEN concat('сноска ', n)
    WHEN b % 4 = 0 THEN concat('Как на рис. ', n, ' видно.') WHEN b % 4 = 1 THEN concat('См. таблица ', n, ' далее.') ELSE 'Обычный текст.' END AS text,
  CASE WHEN k <= 1 THEN CAST(b % 3 + 1 AS INT) END AS heading_level, k <= 1 AND b % 8 IN (4, 6, 7) AS is_structural_heading, k <= 1 AND b % 8 IN (0, 1, 3, 5) AS is_numbered_heading,
  CAST(11 + a % 5 AS DOUBLE) AS font_size_pt, CASE WHEN b % 6 = 0 THEN 'Arial' ELSE 'Times' END AS font_family, CASE rf WHEN 'N' THEN 'justify' WHEN 'A' THEN 'left' ELSE 'center' END AS alignment,
  CASE WHEN b % 2 = 0 THEN 1.25 WHEN b % 5 = 0 THEN NULL ELSE 0.0 END AS first_line_indent_cm, CASE WHEN q > 40 THEN 0.5 ELSE 0.0 END AS left_indent_cm, CASE WHEN q < 4 THEN 0.75 ELSE 0.0 END AS right_indent_cm,
  CASE WHEN d < 0.04 THEN 1.0 ELSE 1.5 END AS line_spacing, CAST(b % 3 * 6 AS DOUBLE) AS space_before_pt, CAST(a % 3 * 6 AS DOUBLE) AS space_after_pt, t > 0.03 AS keep_with_next, t > 0.05 AS keep_together, b % 9 = 0 AS page_break_before, b % 13 = 0 AS has_page_break,
  {_BOLD} AS bold, b % 7 = 0 AS italic, CASE WHEN b % 5 = 0 THEN 'FF0000' ELSE '000000' END AS color, k >= 8 AND b % 5 = 1 AS has_inline_image,
  CASE WHEN k = 5 THEN CAST(b % 2 AS INT) END AS table_ix, CASE WHEN k = 5 THEN CAST(para_ix % 3 AS INT) END AS table_row_ix, CASE WHEN k = 5 THEN CAST(a % 2 AS INT) END AS table_col_ix
FROM named"""


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _duck(sql: str) -> str:
    return sql.replace("{lineitem}", "lineitem")


def _p(rest: str) -> str:
    return f"WITH p AS ({_duck(PARAGRAPHS)}), {rest}"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _of(spark, sf_dir, PARAGRAPHS)
    run = F.struct(F.lit(0).alias("run_ix"), F.col("text").alias("text"), F.col("bold").alias("bold"), F.col("italic").alias("italic"), F.col("font_size_pt").alias("font_size_pt"), F.col("color").alias("font_color"))
    return df.withColumn("runs", F.array(run))


def _main(column: str, name: str, where: str = "paragraph_type = 'main_text'", order: str = "para_ix", table: str = "p", keys: str = "doc_id") -> str:
    """name: the most frequent value of a column in each document; of equals the one seen first, then the smaller."""
    return f"{name} AS (SELECT {keys}, v AS {name} FROM (SELECT {keys}, {column} AS v, count(*) AS n, min({order}) AS f FROM {table} WHERE {where} AND {column} IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f, v) = 1)"


def _union(table: str, rules: list[tuple[str, str] | tuple[str, str, str]], keys: str = "doc_id, para_ix") -> str:
    """Rows of a table that break each rule: (parameter, condition, level)."""
    return " UNION ALL ".join(f"SELECT {keys}, '{r[0]}' AS parameter, '{r[2] if len(r) > 2 else 'error'}' AS level FROM {table} WHERE {r[1]}" for r in rules)


_ZERO = "coalesce({0}, 0)"
_FI, _LI, _RI = (f"abs(coalesce({c}_indent_cm, 0)) <= 0.05" for c in ("first_line", "left", "right"))
_NO_INDENTS = f"({_FI} AND {_LI} AND {_RI})"
_LETTERS = r"regexp_replace(text, '\P{L}', '', 'g')"
_FIRST = r"regexp_extract(regexp_replace(text, '^\d+(\.\d+)*\.?\s*', ''), '\p{L}')"
_SIZES = """levels AS (SELECT doc_id, heading_level, count(*) OVER (PARTITION BY doc_id) AS n, max(heading_level) OVER (PARTITION BY doc_id) AS low FROM (SELECT DISTINCT doc_id, heading_level FROM p WHERE paragraph_type = 'heading')),
sizes AS (SELECT doc_id, heading_level, main + 2 * CASE n WHEN 1 THEN 1 WHEN 2 THEN low - heading_level + 1 ELSE low - heading_level END AS expected FROM levels JOIN main USING (doc_id))"""


@query(
    _p(
        f"{_main('font_size_pt', 'main')}, {_main('first_line_indent_cm', 'main_indent')}, {_main('line_spacing', 'main_spacing')}, {_SIZES}, "
        "marked AS (SELECT *, lag(has_page_break) OVER (PARTITION BY doc_id ORDER BY para_ix) AS broken FROM p), "
        "h AS (SELECT * FROM marked LEFT JOIN sizes USING (doc_id, heading_level) LEFT JOIN main_indent USING (doc_id) LEFT JOIN main_spacing USING (doc_id) WHERE paragraph_type = 'heading') "
        + _union(
            "h",
            [
                ("numbering_terminal_dot", r"regexp_matches(text, '^\d') AND NOT regexp_matches(text, '^\d+(\.\d+)*\. \S')"),
                ("starts_with_capital", rf"{_FIRST} <> '' AND NOT regexp_matches({_FIRST}, '\p{{Lu}}')"),
                ("heading_font_size_hierarchy", "abs(font_size_pt - expected) > 0.5"),
                ("heading_indent_policy", f"CASE WHEN alignment = 'center' THEN NOT {_NO_INDENTS} ELSE NOT ({_LI} AND {_RI} AND ({_FI} OR abs(coalesce(first_line_indent_cm, 0) - coalesce(main_indent, 1.25)) <= 0.05)) END"),
                ("page_break_before", "heading_level = 1 AND NOT (page_break_before OR has_page_break OR coalesce(broken, false))"),
                ("heading_line_spacing_max_main", "line_spacing > main_spacing + 0.05"),
                ("heading_spacing_order", "space_before_pt <= space_after_pt"),
                ("heading_space_after_min_single", "space_after_pt <= 0"),
                ("heading_all_caps", rf"length({_LETTERS}) >= 8 AND NOT regexp_matches({_LETTERS}, '\p{{Ll}}')"),
                ("heading_color_only", "color <> '000000' AND NOT (bold OR coalesce(font_size_pt >= expected - 0.5, false))"),
            ],
        )
    )
)
def heading_findings(spark, sf_dir):
    """The heading rules: numbers, capitals, sizes by level, indents, page breaks, spacing, capitals and colour."""
    return formatting.heading_faults(paragraphs(spark, sf_dir)).select("doc_id", "para_ix", "parameter", "level")


@query(
    _p(
        f"{_main('font_size_pt', 'main')}, {_main('font_family', 'family')}, "
        "body AS (SELECT *, min(CASE WHEN text <> '' THEN para_ix END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN text <> '' THEN para_ix END) OVER (PARTITION BY doc_id) AS hi, lag(paragraph_type) OVER o AS prev, lead(paragraph_type) OVER o AS next FROM p LEFT JOIN main USING (doc_id) LEFT JOIN family USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY para_ix)) "
        + _union(
            "body",
            [
                ("centered_text_no_indents", f"alignment = 'center' AND text <> '' AND paragraph_type <> 'table_cell' AND coalesce(caption_kind, '') <> 'table' AND NOT {_NO_INDENTS}"),
                ("additional_text_font_size_relative", "paragraph_type IN ('caption', 'footnote', 'table_cell') AND main IS NOT NULL AND NOT (abs(font_size_pt - main + 2) <= 0.5 OR (abs(font_size_pt - main) <= 0.5 AND font_family <> family))"),
                ("empty_paragraph_between_content", "text = '' AND para_ix > lo AND para_ix < hi"),
                ("empty_paragraph_around_heading", "text = '' AND (prev = 'heading' OR next = 'heading')"),
                ("additional_spacing_limit", "space_before_pt > 6.5"),
                ("additional_spacing_limit", "space_after_pt > 6.5"),
            ],
        )
    )
)
def text_findings(spark, sf_dir):
    """Centred text with indents, sizes of additional text, empty paragraphs, and spacing over a limit."""
    p = paragraphs(spark, sf_dir)
    return formatting.text_faults(p).unionByName(formatting.spacing_limit_faults(p, 6.0), allowMissingColumns=True).select("doc_id", "para_ix", "parameter", "level")


_UPPER = r"regexp_matches(regexp_extract(caption_title, '\p{L}'), '\p{Lu}')"
_DASH, _DOT = r"regexp_matches(text, '^\S+\s+\d+(\.\d+)*\s*[—–-]')", r"regexp_matches(text, '^\S+\s+\d+(\.\d+)*\.')"


@query(
    _p(
        f"{_main('font_size_pt', 'm')}, {_main('caption_prefix', 'modal', 'caption_kind = ' + chr(39) + 'figure' + chr(39))}, "
        "near AS (SELECT doc_id, para_ix, paragraph_type, has_inline_image, caption_kind, lag(has_inline_image, 1, false) OVER o AS i1, lag(has_inline_image, 2, false) OVER o AS i2, lag(has_inline_image, 3, false) OVER o AS i3, lag(paragraph_type, 1) OVER o AS t1, lag(paragraph_type, 2) OVER o AS t2 FROM p WHERE (text <> '' OR has_inline_image) AND paragraph_type <> 'table_cell' WINDOW o AS (PARTITION BY doc_id ORDER BY para_ix)), "
        "anchors AS (SELECT doc_id, para_ix, has_inline_image OR i1 OR (t1 IS NOT DISTINCT FROM 'caption' AND (i2 OR (t2 IS NOT DISTINCT FROM 'caption' AND i3))) AS anchored FROM near WHERE caption_kind = 'figure'), "
        "c AS (SELECT *, coalesce(m, 14) AS main FROM p JOIN anchors USING (doc_id, para_ix) LEFT JOIN m USING (doc_id) LEFT JOIN modal USING (doc_id)) "
        + _union(
            "c",
            [
                ("figure_caption_position", "NOT anchored"),
                ("figure_caption_alignment", f"alignment <> 'center' OR NOT {_NO_INDENTS}"),
                ("figure_caption_terminal_dot", "text LIKE '%.'"),
                ("figure_caption_prefix_consistency", "caption_prefix <> modal", "warning"),
                ("figure_caption_dot_after_number", _DASH),
                ("figure_caption_title_format", f"NOT {_UPPER} OR caption_title LIKE '%.'"),
                ("figure_caption_font_size", "font_size_pt NOT BETWEEN main - 2.5 AND main - 0.5"),
                ("figure_caption_spacing", "abs(space_before_pt - main / 2) > 0.5"),
                ("figure_caption_spacing", "abs(space_after_pt - main) > 0.5"),
                ("figure_caption_prefix", "caption_prefix <> 'Рисунок'"),
                ("figure_caption_separator", f"NOT {_DASH}"),
            ],
        )
    )
)
def figure_caption_findings(spark, sf_dir):
    """Figure captions: place, form, size and spacing, with a prefix and a separator of the rules."""
    return objects.figure_caption_faults(paragraphs(spark, sf_dir), prefix="Рисунок", separator="dash").select("doc_id", "para_ix", "parameter", "level")


@query(
    _p(
        f"{_main('font_size_pt', 'main')}, c AS (SELECT * FROM p LEFT JOIN main USING (doc_id) WHERE caption_kind = 'table') "
        + _union(
            "c",
            [
                ("table_title_format", f"NOT {_DASH}"),
                ("table_title_format", f"NOT {_UPPER} OR caption_title LIKE '%.'"),
                ("table_title_format", "alignment <> 'left'"),
                ("table_title_format", f"NOT {_FI}"),
                ("table_title_format", "line_spacing > 1.05"),
                ("table_title_font_size", "abs(font_size_pt - main) > 0.5"),
                ("table_title_keep", "NOT (keep_with_next AND keep_together)"),
                ("no_continuation_table_titles", "text LIKE 'Продолжение таблицы%'"),
                ("table_caption_alignment", "alignment <> 'left'"),
                ("table_caption_prefix", "caption_prefix <> 'Таблица'"),
                ("table_caption_separator", f"NOT {_DOT}"),
                ("table_caption_terminal_dot", "text NOT LIKE '%.'"),
            ],
        )
    )
)
def table_caption_findings(spark, sf_dir):
    """Table captions: form, size, keeping, continuation lines, and the values of four rules."""
    return objects.table_caption_faults(paragraphs(spark, sf_dir), alignment="left", prefix="Таблица", separator="dot", terminal_dot=True).select("doc_id", "para_ix", "parameter", "level")


IMAGES = f"WITH base AS ({BASE}) SELECT doc_id, para_ix AS image_ix, para_ix, CAST(8 + b % 3 AS DOUBLE) AS width_cm, CAST(400 + a % 900 AS INT) AS width_px, CAST(300 + b * 9 % 900 AS INT) AS height_px, CASE b % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'bmp' ELSE 'jpg' END AS extension FROM base WHERE a % 12 >= 8 AND b % 5 = 1"


@query(
    _p(
        f"i AS ({_duck(IMAGES)}), {_main('width_cm', 'modal', 'true', 'image_ix', 'i')}, w AS (SELECT * FROM i JOIN modal USING (doc_id)), "
        "r AS (SELECT *, lead(caption_kind) OVER o IS NOT DISTINCT FROM 'figure' AND lead(para_ix) OVER o = para_ix + 1 AS titled FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY para_ix)) "
        + _union("w", [("image_format", "lower(extension) NOT IN ('png', 'jpg')", "warning"), ("image_max_px", "greatest(width_px, height_px) > 1100", "warning"), ("image_size_consistency", "abs(width_cm - modal) > 0.2", "warning")])
        + " UNION ALL "
        + _union("(SELECT * FROM r WHERE has_inline_image)", [("image_paragraph_centered", f"alignment <> 'center' OR NOT {_NO_INDENTS}"), ("image_keep_with_next", "titled AND NOT keep_with_next"), ("image_no_space_after_if_caption", "titled AND space_after_pt > 0.5")])
    )
)
def image_findings(spark, sf_dir):
    """Images: format, size in pixels, equal widths, and how their paragraphs stand to captions."""
    found = objects.image_faults(_of(spark, sf_dir, IMAGES), paragraphs(spark, sf_dir), allowed=("png", "jpg"), max_px=1100)
    return found.select("doc_id", "para_ix", "parameter", "level")


TABLES = """
SELECT doc_id, table_ix, x, CAST(x % 14 AS INT) AS rows_count, x % 3 <> 0 AS has_grid, CASE WHEN x % 5 = 0 THEN '000000' ELSE 'auto' END AS border_color, CAST(x % 2 AS DOUBLE) + 0.5 AS border_size, CASE WHEN x % 4 <> 0 THEN CAST(1 AS INT) END AS title_para_ix, x % 7 <> 0 AS has_header_row,
  CAST(10 + x % 9 AS DOUBLE) AS width_cm, x % 2 = 0 AS has_cant_split_rows, x % 5 = 1 AS repeats_header, CASE WHEN x % 6 = 0 THEN CAST(x % 4 AS INT) END AS empty_ix, CASE WHEN x % 8 = 0 THEN CAST(x % 3 AS INT) END AS tall_ix
FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, CAST(l_orderkey % 3 AS INT) AS table_ix, max(l_partkey + l_suppkey) AS x FROM {lineitem} GROUP BY 1, 2) AS made"""
SECTIONS = """
SELECT doc_id, section_ix, x, 21.0 + 0 * x AS page_width_cm, 29.7 AS page_height_cm, CASE WHEN x % 2 = 0 THEN 3.0 ELSE 2.0 END AS left_margin_cm, CASE WHEN x % 3 = 0 THEN 1.5 ELSE 2.5 END AS right_margin_cm, 2.0 AS top_margin_cm, 2.0 AS bottom_margin_cm, 1.0 + x % 2 AS header_distance_cm, 1.25 AS footer_distance_cm,
  x % 4 <> 0 AS has_page_number, CASE WHEN x % 4 = 0 THEN NULL WHEN x % 5 = 0 THEN 'header' ELSE 'footer' END AS page_number_area, CASE x % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS page_number_start, x % 7 = 0 AS page_number_restart, x % 3 = 0 AS has_header, CASE WHEN x % 3 = 0 THEN 'Титул' END AS header_text, x % 2 = 0 AS first_page_has_page_number,
  CASE WHEN x % 9 = 0 THEN 'A5' ELSE 'A4' END AS page_format, CASE WHEN x % 8 = 0 THEN 'landscape' ELSE 'portrait' END AS page_orientation, CASE WHEN x % 5 = 1 THEN 'right' ELSE 'center' END AS page_number_alignment
FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, CAST(l_orderkey % 3 AS INT) AS section_ix, max(l_partkey + 2 * l_suppkey) AS x FROM {lineitem} GROUP BY 1, 2) AS made"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_of(_of(spark, sf_dir, TABLES))


def _tables_of(df: DataFrame) -> DataFrame:
    listed = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    return df.withColumns({"empty_row_ix": listed("empty_ix"), "enlarged_row_ix": listed("tall_ix")})


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections_of(_of(spark, sf_dir, SECTIONS))


def _sections_of(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c.endswith("_cm")})


_SIGN = "concat(border_color, ' ', border_size)"


@query(
    f"WITH t AS ({_duck(TABLES)}), s AS ({_duck(SECTIONS)}), area AS (SELECT doc_id, page_width_cm - left_margin_cm - right_margin_cm AS area FROM s WHERE section_ix = 0), {_main(_SIGN, 'modal', 'has_grid', 'table_ix', 't')}, w AS (SELECT *, rows_count > 8 AS long FROM t LEFT JOIN area USING (doc_id) LEFT JOIN modal USING (doc_id)) "
    + _union(
        "w",
        [
            ("table_grid_style", "NOT has_grid"),
            ("table_grid_style", f"has_grid AND {_SIGN} <> modal", "warning"),
            ("table_caption_position", "title_para_ix IS NULL"),
            ("table_title_position", "title_para_ix IS NULL"),
            ("table_header_required", "NOT has_header_row"),
            ("table_width_within_text_area", "width_cm > area"),
            ("table_allow_row_break", "long AND has_cant_split_rows", "warning"),
            ("table_repeat_header", "long AND NOT repeats_header", "warning"),
            ("table_no_empty_rows", "empty_ix IS NOT NULL"),
            ("table_no_empty_rows", "tall_ix IS NOT NULL", "warning"),
        ],
        "doc_id, table_ix",
    )
)
def table_findings(spark, sf_dir):
    """Whole tables: borders, titles, headers, width, long tables, empty and enlarged rows."""
    return objects.table_faults(tables(spark, sf_dir), sections(spark, sf_dir)).select("doc_id", "table_ix", "parameter", "level")


@query(
    _p(
        f"{_main('font_size_pt', 'main')}, {_main('font_size_pt', 'modal', 'paragraph_type = ' + chr(39) + 'table_cell' + chr(39))}, c AS (SELECT *, coalesce(main, 14) AS m FROM p LEFT JOIN main USING (doc_id) LEFT JOIN modal USING (doc_id) WHERE paragraph_type = 'table_cell'), "
        f"reasons AS (SELECT doc_id, table_ix, para_ix, line_spacing > 1.05 AS spaced, NOT {_NO_INDENTS} AS indented, table_row_ix <> 0 AND alignment <> 'left' AS turned FROM c), columns AS (SELECT doc_id, table_ix, table_col_ix, min(alignment) AS low, max(alignment) AS high, bool_and(text = '—') AS dashes, min(para_ix) AS para_ix FROM c WHERE table_row_ix > 0 AND text <> '' GROUP BY ALL) "
        "SELECT doc_id, table_ix, min(para_ix) AS para_ix, 'table_text_spacing_indent' AS parameter, concat_ws(', ', CASE WHEN bool_or(turned) THEN 'alignment' END, CASE WHEN bool_or(indented) THEN 'indents' END, CASE WHEN bool_or(spaced) THEN 'line spacing' END) AS actual FROM reasons WHERE spaced OR indented OR turned GROUP BY ALL "
        "UNION ALL SELECT doc_id, table_ix, min(para_ix), 'table_text_line_spacing', 'line spacing' FROM reasons WHERE spaced GROUP BY ALL "
        "UNION ALL SELECT doc_id, table_ix, min(para_ix), x, concat(arg_min(CAST(font_size_pt AS INTEGER), para_ix), ' in ', count(*), ' cells') FROM c, (VALUES ('table_font_size'), ('table_text_font_size')) v(x) WHERE abs(font_size_pt - m) > 0.5 AND abs(font_size_pt - m + 2) > 0.5 GROUP BY doc_id, table_ix, x "
        "UNION ALL SELECT doc_id, table_ix, min(para_ix), 'table_font_size_consistency', concat(arg_min(CAST(font_size_pt AS INTEGER), para_ix), ' in ', count(*), ' cells') FROM c WHERE font_size_pt <> modal GROUP BY doc_id, table_ix "
        "UNION ALL SELECT doc_id, table_ix, para_ix, 'table_column_alignment_consistency', CASE WHEN low <> high THEN concat('column ', table_col_ix + 1, ' ', (SELECT string_agg(DISTINCT alignment, '/' ORDER BY alignment) FROM c WHERE c.doc_id = columns.doc_id AND c.table_ix = columns.table_ix AND c.table_col_ix = columns.table_col_ix AND table_row_ix > 0 AND text <> '')) ELSE concat('dash column ', table_col_ix + 1) END FROM columns WHERE low <> high OR (dashes AND low <> 'center')"
    )
)
def cell_findings(spark, sf_dir):
    """Table cells by table: spacing, indents, alignment, sizes against the main size and among themselves, columns of mixed alignment or of dashes."""
    return objects.cell_faults(paragraphs(spark, sf_dir)).select("doc_id", "table_ix", "para_ix", "parameter", "actual")


#: Paragraphs of a thesis: every line of an order is one kind of paragraph of one part.
THESIS = """
SELECT doc_id, para_ix, m, CASE WHEN m IN (0, 1, 14) THEN 'heading' WHEN m IN (5, 6, 11) THEN 'list_item' WHEN m = 16 THEN 'title_page' ELSE 'main_text' END AS paragraph_type,
  CASE WHEN m IN (2, 3) THEN 'toc' WHEN m BETWEEN 4 AND 7 OR m = 17 THEN 'introduction' WHEN m BETWEEN 8 AND 10 THEN 'conclusion' WHEN m IN (11, 12, 18) THEN 'references' WHEN m = 16 THEN 'title_page' ELSE 'main_part' END AS logical_section,
  CASE m WHEN 0 THEN 'Обзор' WHEN 1 THEN 'Overview of parts' WHEN 2 THEN 'Обзор ..... 5' WHEN 3 THEN 'Методы … 7' WHEN 4 THEN 'Для этого решить следующие задачи:' WHEN 5 THEN '— изучить  литературу' WHEN 6 THEN '— и разработка модели' WHEN 7 THEN 'Актуальность   Темы ясна' WHEN 8 THEN 'Разработан метод.' WHEN 9 THEN 'В будущем планируется рост.'
    WHEN 10 THEN 'Итоги есть.' WHEN 11 THEN '1. Петров' WHEN 12 THEN 'без даты' WHEN 13 THEN 'Я считаю так, а не иначе' WHEN 14 THEN 'Методы' WHEN 15 THEN 'Мы сделали это' WHEN 16 THEN 'Университет' WHEN 17 THEN 'Цель работы' WHEN 18 THEN 'Сидоров, 2001' ELSE 'Описание счётов' END AS text,
  m = 14 AS is_numbered_heading, CASE WHEN m IN (5, 6) THEN 'dash' WHEN m = 11 THEN 'number_dot' END AS list_marker_type
FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, CAST((l_orderkey % 3) * 8 + l_linenumber AS INT) AS para_ix, CAST(max(l_partkey + 3 * l_suppkey) % 20 AS INT) AS m FROM {lineitem} GROUP BY 1, 2) AS made"""


def _t(rest: str) -> str:
    return f"WITH p AS ({_duck(THESIS)}), {rest}"


@query(
    _t(
        f"s AS ({_duck(SECTIONS)}), titled AS (SELECT DISTINCT doc_id FROM p WHERE paragraph_type = 'title_page'), intro AS (SELECT doc_id, min(para_ix) AS began FROM p WHERE logical_section = 'introduction' GROUP BY doc_id), front AS (SELECT doc_id, count(*) FILTER (para_ix < began AND text <> '') AS n FROM p JOIN intro USING (doc_id) GROUP BY doc_id), "
        "w AS (SELECT *, doc_id IN (FROM titled) AS has_title FROM s LEFT JOIN front USING (doc_id)) "
        + _union(
            "w",
            [
                ("continuous_page_numbering", "CASE WHEN section_ix = 0 THEN coalesce(page_number_start <> 1, false) ELSE page_number_restart END"),
                ("page_number_area", "NOT has_page_number OR page_number_area <> 'footer'"),
                ("header_short_title", "has_header", "warning"),
                ("first_page_no_page_number", "section_ix = 0 AND first_page_has_page_number AND has_title"),
                ("front_matter_page_numbers_hidden_until_intro", "section_ix = 0 AND first_page_has_page_number AND n > 0"),
                ("front_matter_page_numbers_hidden_until_intro", "section_ix = 0 AND has_page_number AND n > 12"),
            ],
            "doc_id, section_ix",
        )
    )
)
def section_findings(spark, sf_dir):
    """Sections: numbering, place of page numbers, headers, title pages and front matter."""
    return documents.section_faults(sections(spark, sf_dir), _of(spark, sf_dir, THESIS)).select("doc_id", "section_ix", "parameter", "level")


_PLAIN = "replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'ё', 'е')"


@query(
    _t(
        f"n AS (SELECT *, {_PLAIN} AS plain FROM p), d AS (SELECT doc_id, string_agg(plain, ' ' ORDER BY para_ix) AS whole, bool_or(is_numbered_heading) AS numbered, bool_or(logical_section = 'conclusion' AND paragraph_type <> 'heading') AS concluded, count(*) FILTER (logical_section = 'references' AND m IN (11, 18)) AS n_references, "
        "coalesce(string_agg(plain, ' ') FILTER (logical_section = 'introduction'), '') AS intro FROM n GROUP BY doc_id), "
        "heads AS (SELECT DISTINCT doc_id, plain FROM n WHERE paragraph_type = 'heading'), toc AS (SELECT doc_id, para_ix, trim(regexp_replace(plain, '[.…\\s]*\\d+$', '')) AS t FROM n WHERE logical_section = 'toc'), lost AS (SELECT * FROM toc WHERE NOT EXISTS (SELECT 1 FROM heads WHERE heads.doc_id = toc.doc_id AND heads.plain = t)), "
        "missing AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT contains(whole, 'введение') THEN 'Введение' END, CASE WHEN NOT contains(whole, 'обзор') THEN 'Обзор' END, CASE WHEN NOT (numbered OR contains(whole, 'основная часть')) THEN 'Основная часть' END, CASE WHEN NOT contains(whole, 'метод. итоги') THEN 'метод. Итоги' END], lambda x: x IS NOT NULL), ', ') AS found FROM d), "
        "asked AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT (contains(intro, 'цель') AND contains(intro, 'работы')) THEN 'цель работы' END, CASE WHEN NOT contains(intro, 'актуальность') THEN 'Актуальность' END], lambda x: x IS NOT NULL), ', ') AS found FROM d) "
        "SELECT doc_id, para_ix, 'heading_english_not_allowed' AS parameter, text AS actual FROM p WHERE m = 1 "
        "UNION ALL SELECT doc_id, NULL, 'toc_headings_match_text', array_to_string(list_slice(list(t ORDER BY para_ix), 1, 5), '; ') FROM lost GROUP BY doc_id "
        "UNION ALL SELECT doc_id, NULL, 'conclusion_required_content', 'no conclusion' FROM d WHERE NOT concluded "
        "UNION ALL SELECT doc_id, NULL, 'required_document_structure', found FROM missing WHERE found <> '' "
        "UNION ALL SELECT doc_id, NULL, 'references_min_count', CAST(n_references AS VARCHAR) FROM d WHERE n_references < 2 "
        "UNION ALL SELECT doc_id, NULL, 'introduction_required_content', found FROM asked WHERE found <> ''"
    )
)
def structure_findings(spark, sf_dir):
    """Structure: required parts over the whole text, contents lines, introductions, conclusions, references, English headings."""
    found = documents.structure_faults(_of(spark, sf_dir, THESIS), required=["Введение", "Обзор", "Основная часть", "метод. Итоги"], least_references=2, intro_items=["цель работы", "Актуальность"])
    return found.select("doc_id", "para_ix", "parameter", "actual")


@query(
    _t(
        "i AS (SELECT *, bool_or(m = 4) OVER (PARTITION BY doc_id ORDER BY para_ix) AS inside FROM p WHERE logical_section = 'introduction'), j AS (SELECT *, m IN (5, 6) AS item, bool_or(m IN (5, 6)) OVER (PARTITION BY doc_id ORDER BY para_ix) AS began FROM i WHERE inside AND m <> 4), tasks AS (SELECT *, bool_or(began AND NOT item) OVER (PARTITION BY doc_id ORDER BY para_ix) AS ended FROM j) "
        "SELECT doc_id, para_ix, 'initial_verb_form' AS parameter, 'разработка' AS actual FROM tasks WHERE item AND NOT ended AND m = 6 "
        "UNION ALL SELECT doc_id, para_ix, 'completed_action_form', 'планируется' FROM p WHERE m = 9 "
        "UNION ALL SELECT doc_id, min(para_ix), 'completed_action_form', 'no completed action' FROM p WHERE m BETWEEN 8 AND 10 GROUP BY doc_id HAVING bool_and(m = 10) "
        "UNION ALL SELECT doc_id, para_ix, 'forbidden_phrases', CASE m WHEN 13 THEN 'я считаю' WHEN 15 THEN 'мы сделать' ELSE 'описание счетов' END FROM p WHERE m IN (13, 15, 19)"
    )
)
def language_findings(spark, sf_dir):
    """Tasks that begin with no infinitive, conclusions without completed action, and forbidden phrases by words and by lemmas."""
    found = documents.language_faults(_of(spark, sf_dir, THESIS), phrases=["я считаю", "мы сделать", "описание счетов"])
    return found.select("doc_id", "para_ix", "parameter", "actual")


@query(_t("n AS (SELECT * FROM p WHERE logical_section = 'introduction') SELECT doc_id, string_agg(text, chr(10) ORDER BY para_ix) AS text FROM n GROUP BY doc_id"))
def introduction_texts(spark, sf_dir):
    """The text of each introduction."""
    return documents.section_text(_of(spark, sf_dir, THESIS), "introduction")


#: Lists, equations, notations and footnotes.
LISTS = f"""
WITH base AS ({BASE}), kinds AS (SELECT *, CAST(a % 9 AS INT) AS k, CAST(b % 4 + 1 AS STRING) AS n FROM base),
marked AS (SELECT *, CASE WHEN k <= 3 THEN CASE b % 7 WHEN 0 THEN 'dash' WHEN 1 THEN 'hyphen' WHEN 2 THEN 'bullet' WHEN 3 THEN 'number_bracket' WHEN 4 THEN 'number_dot' WHEN 5 THEN 'letter_dot' END END AS list_marker_type, CASE WHEN k <= 3 THEN CASE b % 7 WHEN 0 THEN '—' WHEN 1 THEN '-' WHEN 2 THEN '•' WHEN 3 THEN '1)' WHEN 4 THEN '2.' WHEN 5 THEN 'а.' END END AS list_marker,
  CASE a % 4 WHEN 0 THEN 'один;' WHEN 1 THEN 'Два.' WHEN 2 THEN 'три' ELSE 'Четыре;' END AS body FROM kinds)
SELECT doc_id, para_ix, k, CASE WHEN k <= 3 THEN 'list_item' WHEN k = 7 THEN 'footnote' ELSE 'main_text' END AS paragraph_type, list_marker, list_marker_type, d > 0.05 AS is_automatic_list, body,
  CASE WHEN k <= 3 THEN CASE WHEN list_marker IS NULL THEN body ELSE concat(list_marker, ' ', body) END WHEN k = 4 THEN CASE WHEN b % 2 = 0 THEN 'Части таковы:' ELSE 'Части есть.' END WHEN k = 5 THEN CASE b % 4 WHEN 0 THEN concat('E = mc (', n, ')') WHEN 1 THEN concat('как формула (', n, ') и') WHEN 2 THEN 'F = m +' ELSE 'слово* тут' END
    WHEN k = 6 THEN CASE b % 3 WHEN 0 THEN concat('m = n (', n, ')') WHEN 1 THEN concat('см. (', n, ') и') ELSE 'плотность' END WHEN k = 7 THEN 'сноска' ELSE CASE b % 8 WHEN 0 THEN 'тут × знак' WHEN 1 THEN 'тут · знак' WHEN 2 THEN '2,5·10 раз' WHEN 3 THEN '3,1E5 раз' WHEN 4 THEN '+7 912 345-67-89' WHEN 5 THEN '8 912 345-67-89' WHEN 6 THEN 'путь м/с' ELSE 'путь м·с' END END AS text,
  CASE WHEN b % 2 = 0 THEN 1.25 ELSE 0.5 END AS first_line_indent_cm, CASE WHEN q > 30 THEN 0.5 ELSE 0.0 END AS left_indent_cm, 0.0 * q AS right_indent_cm, CASE rf WHEN 'N' THEN 'left' ELSE 'center' END AS alignment, k IN (5, 6) AND t > 0.02 AS has_equation, k IN (5, 6) AND a % 2 = 0 AS has_line_break, k IN (5, 6) AND t > 0.05 AS is_standalone_equation, k = 6 AND t < 0.02 AS has_formula_like_image,
  CAST(NULL AS STRING) AS style_name, CAST(NULL AS STRING) AS caption_kind, CAST(NULL AS STRING) AS logical_section, CASE WHEN b % 6 = 0 THEN 'Arial' ELSE 'Times' END AS font_family, CAST(11 + b % 3 AS DOUBLE) AS font_size_pt, CASE WHEN d < 0.04 THEN 1.0 ELSE 1.5 END AS line_spacing
FROM marked"""
META = "SELECT doc_id, x % 3 <> 0 AS has_footnotes_part, CASE x % 4 WHEN 0 THEN 'lowerRoman' WHEN 1 THEN 'decimal' END AS footnote_number_format, CASE x % 5 WHEN 0 THEN 'eachPage' WHEN 1 THEN 'continuous' END AS footnote_number_restart FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, max(l_partkey) AS x FROM {lineitem} GROUP BY 1) AS made"


def _l(rest: str) -> str:
    return f"WITH p AS ({_duck(LISTS)}), {rest}"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, LISTS).withColumn("right_indent_cm", F.lit(0.0))


def profile(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rules of one profile: (parameter, value, target, operator, modality) with defaults from the right."""
    made = []
    for i, row in enumerate(rows):
        parameter, value, target, operator, modality = (*row, *(None, "document", "equals", "mandatory")[len(row) - 1 :])
        number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        made.append(("p", f"{parameter}-{i}", i, "formatting", target, parameter, operator, number, value if isinstance(value, str) else None, value if isinstance(value, bool) else None, value if isinstance(value, list) else None, None, modality, str(i + 1), True))
    df = spark.createDataFrame(made, "profile_id string, rule_id string, ordinal int, category string, target string, parameter string, operator string, value_num double, value_str string, value_bool boolean, value_list array<string>, unit string, modality string, source_section string, enabled boolean")
    return df.withColumn("condition", F.expr("parse_json(null)")).withColumn("consistency_strategy", F.expr("parse_json(null)"))


_NUMBERED = "coalesce(list_marker_type IN ('number_bracket', 'number_dot', 'letter_bracket', 'letter_dot'), false)"
_EQUATION = r"regexp_matches(text, '\(\d+(\.\d+)*\)\s*$')"
LIST_RULES = ("list_marker_allowed", "list_marker_dash_required", "hyphen_list_marker_not_recommended", "list_indent_equals_main_text", "automatic_list_numbering_required")
EQUATION_RULES = ("equations_editable", "long_equation_standalone", "equation_alignment_left", "equation_number_right", "equation_line_break_rule")


@query(
    _l(
        f"{_main('first_line_indent_cm', 'main_indent')}, w AS (SELECT * FROM p LEFT JOIN main_indent USING (doc_id)), i AS (SELECT * FROM w WHERE paragraph_type = 'list_item') "
        + _union(
            "i",
            [
                ("list_marker_allowed", "list_marker_type IS NULL AND NOT is_automatic_list"),
                ("list_marker_dash_required", f"NOT {_NUMBERED} AND list_marker_type IS DISTINCT FROM 'dash'"),
                ("hyphen_list_marker_not_recommended", "list_marker_type = 'hyphen'", "warning"),
                ("list_indent_equals_main_text", "abs(first_line_indent_cm - main_indent) > 0.05"),
                ("automatic_list_numbering_required", f"{_NUMBERED} AND NOT is_automatic_list"),
            ],
        )
        + " UNION ALL "
        + _union(
            "w",
            [
                ("equations_editable", "has_formula_like_image", "warning"),
                ("long_equation_standalone", f"{_EQUATION} AND NOT has_equation AND paragraph_type = 'main_text'", "warning"),
                ("equation_alignment_left", "is_standalone_equation AND alignment <> 'left'"),
                ("equation_number_right", f"is_standalone_equation AND NOT {_EQUATION}"),
                ("equation_line_break_rule", r"has_equation AND has_line_break AND NOT regexp_matches(text, '[=+\-−±×·/]\s*$')"),
            ],
        )
    )
)
def list_and_equation_findings(spark, sf_dir):
    """Markers, indents and numbering of list items; place, number and breaks of equations."""
    found = typography.check_paragraphs(lists(spark, sf_dir), profile(spark, *((p,) for p in (*LIST_RULES, *EQUATION_RULES))))
    return found.select("doc_id", F.col("paragraph_index").alias("para_ix"), "parameter", F.col("severity").alias("level"))


_ISLANDS = """isl AS (SELECT *, sum(CASE WHEN paragraph_type = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_ix) AS list_ix, last_value(text) OVER (PARTITION BY doc_id ORDER BY para_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM p),
items AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY doc_id, list_ix) AS size, first_value(above) OVER w AS before FROM isl WHERE paragraph_type = 'list_item' WINDOW w AS (PARTITION BY doc_id, list_ix ORDER BY para_ix)),
i AS (SELECT *, coalesce(before, '') LIKE '%:' AND coalesce(list_marker_type IN ('dash', 'hyphen', 'bullet'), false) AS ruled, body[1] AS first FROM items)"""
_ITEM_SIGN = f"concat_ws(' ', coalesce(list_marker_type, 'none'), CASE WHEN NOT {_NUMBERED} THEN list_marker END)"
_ITEM_INDENT = "concat_ws('/', CASE first_line_indent_cm WHEN 1.25 THEN '1.25' ELSE '0.5' END, CASE left_indent_cm WHEN 0.5 THEN '0.5' ELSE '0' END, '0')"


@query(
    _l(
        f"{_ISLANDS}, {_main(_ITEM_SIGN, 'modal_sign', 'true', 'para_ix', 'i', 'doc_id, list_ix')}, {_main(_ITEM_INDENT, 'modal_indent', 'size >= 2', 'para_ix', 'i', 'doc_id, list_ix')} "
        "SELECT doc_id, para_ix, 'list_punctuation_policy' AS parameter, 'starts with a capital' AS fragment FROM i WHERE ruled AND first <> lower(first) "
        "UNION ALL SELECT doc_id, para_ix, 'list_punctuation_policy', 'no semicolon at the end' FROM i WHERE ruled AND place < size AND body NOT LIKE '%;' UNION ALL SELECT doc_id, para_ix, 'list_punctuation_policy', 'no full stop at the end' FROM i WHERE ruled AND place = size AND body NOT LIKE '%.' "
        "UNION ALL SELECT doc_id, para_ix, 'list_punctuation_policy', 'starts with a small letter' FROM i WHERE list_marker_type IN ('number_dot', 'letter_dot') AND first <> upper(first) "
        f"UNION ALL SELECT doc_id, para_ix, 'list_marker_consistency', {_ITEM_SIGN} FROM i JOIN modal_sign USING (doc_id, list_ix) WHERE {_ITEM_SIGN} <> modal_sign UNION ALL SELECT doc_id, para_ix, 'list_indent_consistency', {_ITEM_INDENT} FROM i JOIN modal_indent USING (doc_id, list_ix) WHERE size >= 2 AND {_ITEM_INDENT} <> modal_indent"
    )
)
def list_consistency_findings(spark, sf_dir):
    """Case, ends, markers and indents of items against their list and the text before it."""
    return typography.list_consistency(lists(spark, sf_dir)).select("doc_id", "para_ix", "parameter", "fragment")


@query(
    _l(
        r"ways AS (SELECT DISTINCT doc_id, 'multiplication_sign_consistency' AS parameter, '' AS key, x AS way FROM p, (VALUES ('×'), ('·')) v(x) WHERE contains(text, x) UNION SELECT doc_id, 'scientific_notation_consistency', '', CASE WHEN contains(text, 'E5') THEN 'exponent' ELSE 'power of ten' END FROM p WHERE k = 8 AND text LIKE '% раз' "
        "UNION SELECT doc_id, 'phone_country_code_consistency', '', CASE WHEN text LIKE '+7%' THEN '+7' ELSE '8' END FROM p WHERE text LIKE '%345-67-89' UNION SELECT doc_id, 'dimension_consistency', 'м с', text[6:] FROM p WHERE text LIKE 'путь%') "
        "SELECT doc_id, parameter, string_agg(way, ', ' ORDER BY way) AS fragment, CASE WHEN parameter IN ('multiplication_sign_consistency', 'dimension_consistency') THEN 'warning' ELSE 'error' END AS level FROM ways GROUP BY doc_id, parameter, key HAVING count(*) > 1 "
    )
)
def notation_findings(spark, sf_dir):
    """Documents that write products, powers, phone numbers or units in different ways."""
    return typography.notation_mixes(lists(spark, sf_dir)).select("doc_id", "parameter", "fragment", "level")


@query(
    _l(
        r"own AS (SELECT DISTINCT doc_id, regexp_extract(text, '\((\d+)\)\s*$', 1) AS n FROM p WHERE has_equation AND regexp_matches(text, '\(\d+\)\s*$')), named AS (SELECT DISTINCT doc_id, regexp_extract(text, '(?:формула|см\.) \((\d+)\)', 1) AS n FROM p WHERE regexp_matches(text, '(формула|см\.) \(\d+\)')) "
        "SELECT doc_id, n AS fragment, 'warning' AS level FROM (FROM own EXCEPT FROM named) UNION ALL SELECT doc_id, n, 'error' FROM (FROM named EXCEPT FROM own)"
    )
)
def equation_reference_findings(spark, sf_dir):
    """Equation numbers without a reference, and references without an equation."""
    return typography.equation_reference_gaps(lists(spark, sf_dir)).select("doc_id", "fragment", "level")


def _footnotes() -> str:
    columns = {"font_family": "font_family", "font_size_pt": "CAST(font_size_pt AS VARCHAR)", "alignment": "alignment", "line_spacing": "CAST(line_spacing AS VARCHAR)", "first_line_indent_cm": "CAST(first_line_indent_cm AS VARCHAR)"}
    return " UNION ALL ".join(f"SELECT doc_id, para_ix, '{c}' AS attribute, {e} AS value FROM p WHERE paragraph_type = 'footnote'" for c, e in columns.items())


@query(
    _l(
        f"meta AS ({_duck(META)}), long AS ({_footnotes()}), {_main('value', 'modal', 'true', 'para_ix', 'long', 'doc_id, attribute')}, {_main('font_family', 'family')}, {_main('font_size_pt', 'size')} "
        "SELECT doc_id, CAST(NULL AS INTEGER) AS para_ix, 'footnotes_processor_required' AS parameter FROM meta WHERE NOT has_footnotes_part AND doc_id IN (SELECT doc_id FROM p WHERE text LIKE 'слово*%') "
        "UNION ALL SELECT doc_id, NULL, 'footnotes_continuous_decimal_numbering' FROM meta WHERE has_footnotes_part AND (footnote_number_format = 'lowerRoman' OR footnote_number_restart = 'eachPage') "
        "UNION ALL SELECT doc_id, para_ix, 'footnotes_format_consistency' FROM long JOIN modal USING (doc_id, attribute) WHERE value <> modal "
        "UNION ALL SELECT doc_id, para_ix, 'footnote_font_family_and_size' FROM p JOIN family USING (doc_id) JOIN size USING (doc_id) WHERE paragraph_type = 'footnote' AND (font_family <> family OR abs(font_size_pt - size + 2) > 0.5)"
    )
)
def footnote_findings(spark, sf_dir):
    """The four footnote rules."""
    return typography.footnote_findings(lists(spark, sf_dir), _of(spark, sf_dir, META)).select("doc_id", "para_ix", "parameter")


RUNS = f"WITH base AS ({BASE}) SELECT doc_id, para_ix, CASE b % 8 WHEN 0 THEN 'где x есть' WHEN 1 THEN 'sin угла' WHEN 2 THEN 'вода H2O' WHEN 3 THEN 'слово' WHEN 4 THEN 'КАПИТАЛЬНО тут' WHEN 5 THEN 'iя' WHEN 6 THEN 'инд.' ELSE 'иное' END AS text, b % 8 AS v, a % 2 = 0 AS italic, a % 3 = 0 AS bold, a % 5 = 0 AS underline, a % 7 = 0 AS strike, a % 11 = 0 AS double_strike, a % 13 = 0 AS small_caps, q > 40 AS all_caps, CAST(CASE WHEN d > 0.08 THEN 20 ELSE 0 END AS INT) AS character_spacing, CASE WHEN t < 0.02 THEN 'FF0000' ELSE '000000' END AS font_color, a % 4 = 1 AS subscript, b % 3 = 0 AS has_character_style, b % 5 < 3 AS has_direct_formatting FROM base"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _of(spark, sf_dir, RUNS)
    own = ("bold", "italic", "underline", "strike", "double_strike", "small_caps", "all_caps", "character_spacing", "font_color", "subscript", "has_character_style", "has_direct_formatting")
    run = F.struct(F.lit(0).alias("run_ix"), F.col("text").alias("text"), F.lit(12.0).alias("font_size_pt"), *(F.col(c).alias(c) for c in own))
    none = F.lit(None).cast("string")
    return df.select("doc_id", "para_ix", "text", F.lit("main_text").alias("paragraph_type"), F.lit(12.0).alias("font_size_pt"), none.alias("style_name"), F.array(run).alias("runs"))


RUN_PARAMETERS = ("font_color", "underline", "strike", "double_strike", "small_caps", "all_caps", "character_spacing", "uppercase_emphasis", "emphasis_character_style")
_RUN_FAULTS = [(c, c) for c in ("underline", "strike", "double_strike", "small_caps", "all_caps")] + [
    ("font_color", "font_color <> '000000'"),
    ("character_spacing", "character_spacing <> 0"),
    ("uppercase_emphasis", "v = 4"),
    ("emphasis_character_style", "has_direct_formatting AND NOT has_character_style AND (bold OR italic OR font_color <> '000000')"),
]


@query(f"WITH p AS ({_duck(RUNS)}) {_union('p', _RUN_FAULTS)}")
def run_rule_findings(spark, sf_dir):
    """Every rule on single runs, with a mandatory colour rule."""
    found = formatting.check_runs(runs(spark, sf_dir), profile(spark, *((p,) for p in RUN_PARAMETERS)))
    return found.select("doc_id", F.col("paragraph_index").alias("para_ix"), "parameter", F.col("severity").alias("level"))


@query(f"WITH p AS ({_duck(RUNS)}) {_union('p', [('font_color', _RUN_FAULTS[5][1], 'warning')])}")
def run_colour_advice(spark, sf_dir):
    """A recommended colour rule: once for each paragraph that is of one colour throughout."""
    found = formatting.check_runs(runs(spark, sf_dir), profile(spark, ("font_color", None, "document", "equals", "recommended")))
    return found.select("doc_id", F.col("paragraph_index").alias("para_ix"), "parameter", F.col("severity").alias("level"))


@query(
    f"WITH p AS ({_duck(RUNS)}) "
    + _union(
        "p",
        [
            ("variable_italic", r"NOT italic AND v IN (0)", "warning"),
            ("function_and_chemical_regular", "italic AND v IN (1, 2)", "warning"),
            ("index_language_consistency", "subscript AND v IN (0, 1, 2, 5)", "warning"),
            ("index_language_consistency", "subscript AND v = 6", "error"),
        ],
    )
)
def index_findings(spark, sf_dir):
    """Variables, functions, formulas and indices in runs."""
    found = typography.check_runs(runs(spark, sf_dir), profile(spark, ("variable_italic",), ("function_and_chemical_regular",), ("index_language_consistency",)))
    return found.select("doc_id", F.col("paragraph_index").alias("para_ix"), "parameter", F.col("severity").alias("level"))


def _nulls(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


#: The profile of the whole check.
CHECKED = (
    ("font_size", 12.0, "main_text"), ("alignment", ["justify", "left"], "main_text", "in", "recommended"), ("numbering_terminal_dot",), ("heading_spacing_order", None, "document", "equals", "recommended"), ("centered_text_no_indents",), ("empty_paragraph_between_content",), ("figure_caption_position",), ("figure_caption_prefix", "Рисунок"), ("figure_caption_separator", "—"),
    ("table_title_keep",), ("table_caption_terminal_dot", True), ("image_max_px", 1100.0), ("image_format", ["png", "jpg"]), ("table_after_first_reference",), ("image_after_first_reference",), ("table_header_required",), ("table_title_position",), ("table_text_spacing_indent",), ("table_text_font_size", ["12", "14"]), ("left_margin", 3.0, "page"), ("page_number_area",), ("required_document_structure", ["Введение", "Итоги"]),
    ("nbsp_after_figure_table_reference",), ("font_color",),
)


def whole_blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    """Block tables of whole documents, written once. The lines are dealt by document first, and all tables are made where they lie."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lines.count()  # of the footers; no fewer than the paragraphs
    lines = dealt(lines, F.expr("CAST(floor(l_orderkey / 3.0) AS BIGINT)"), rows=n)
    of = lambda sql: spark.sql(sql, lineitem=lines)
    p = of(PARAGRAPHS)
    run = F.struct(F.lit(0).alias("run_ix"), F.col("text").alias("text"), *(F.lit(False).alias(c) for c in ("bold", "italic", "underline", "strike", "double_strike", "small_caps", "all_caps", "subscript", "has_character_style", "has_direct_formatting")), F.lit(None).cast("double").alias("font_size_pt"), F.col("color").alias("font_color"), F.lit(0).alias("character_spacing"))
    section = F.when((F.col("paragraph_type") == "heading") & (F.col("text") == "Введение"), "introduction").otherwise("main_part")
    p = p.withColumn("runs", F.array(run)).withColumn("logical_section", section)
    p = _nulls(p, style_name="string", list_marker="string", list_marker_type="string", is_automatic_list="boolean", has_equation="boolean", has_formula_like_image="boolean", is_standalone_equation="boolean", has_line_break="boolean")
    return written(Blocks(p, _sections_of(of(SECTIONS)), _tables_of(of(TABLES)), of(IMAGES), of(META)), rows=n)


def with_texts(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """found as the SQL has it: that looks for required parts in a document's joined texts, which are null, and so without a finding, where no paragraph has text. The operator finds all parts missing there."""
    textless = paragraphs.groupBy("doc_id").agg(F.bool_or(F.col("text") != "").alias("_text")).where(~F.col("_text")).select(F.col("doc_id").alias("_textless"))
    return found.join(textless, (F.col("doc_id") == F.col("_textless")) & (F.col("parameter") == "required_document_structure"), "left_anti")


_REFERENCES = "r{k} AS (SELECT doc_id, number, min(para_ix) AS ref_ix FROM (SELECT doc_id, para_ix, regexp_extract(text, '{p} (\\d+)', 1) AS number FROM p WHERE paragraph_type <> 'caption' AND regexp_matches(text, '{p} \\d+')) GROUP BY ALL), c{k} AS (SELECT doc_id, caption_number AS number, max(para_ix) AS para_ix FROM p WHERE caption_kind = '{c}' GROUP BY ALL)"
_WHOLE = [
    ("main_text", "font_size", "abs(font_size_pt - 12) > 0.02", "error"),
    ("main_text", "alignment", "alignment = 'center'", "warning"),
    ("heading", "numbering_terminal_dot", r"regexp_matches(text, '^\d') AND NOT regexp_matches(text, '^\d+(\.\d+)*\. \S')", "error"),
    ("heading", "heading_spacing_order", "space_before_pt <= space_after_pt", "warning"),
]


@query(
    _p(
        f"s AS ({_duck(SECTIONS)}), t AS ({_duck(TABLES)}), i AS ({_duck(IMAGES)}), {_REFERENCES.format(k=1, p='рис\\.', c='figure')}, {_REFERENCES.format(k=2, p='таблица', c='table')}, "
        "near AS (SELECT doc_id, para_ix, paragraph_type, has_inline_image, caption_kind, lag(has_inline_image, 1, false) OVER o AS i1, lag(has_inline_image, 2, false) OVER o AS i2, lag(has_inline_image, 3, false) OVER o AS i3, lag(paragraph_type, 1) OVER o AS t1, lag(paragraph_type, 2) OVER o AS t2 FROM p WHERE (text <> '' OR has_inline_image) AND paragraph_type <> 'table_cell' WINDOW o AS (PARTITION BY doc_id ORDER BY para_ix)), "
        "anchors AS (SELECT doc_id, para_ix, has_inline_image OR i1 OR (t1 IS NOT DISTINCT FROM 'caption' AND (i2 OR (t2 IS NOT DISTINCT FROM 'caption' AND i3))) AS anchored FROM near WHERE caption_kind = 'figure'), "
        f"cells AS (SELECT *, line_spacing > 1.05 AS spaced, NOT {_NO_INDENTS} AS indented, table_row_ix <> 0 AND alignment <> 'left' AS turned FROM p WHERE paragraph_type = 'table_cell'), d AS (SELECT doc_id, string_agg(lower(text), ' ' ORDER BY para_ix) FILTER (text <> '') AS whole FROM p GROUP BY doc_id), "
        "found AS ("
        + " UNION ALL ".join(f"SELECT doc_id, para_ix, '{n}' AS parameter, '{level}' AS severity FROM p WHERE paragraph_type = '{kind}' AND {bad}" for kind, n, bad, level in _WHOLE)
        + f" UNION ALL SELECT doc_id, para_ix, 'centered_text_no_indents', 'error' FROM p WHERE alignment = 'center' AND text <> '' AND paragraph_type <> 'table_cell' AND coalesce(caption_kind, '') <> 'table' AND NOT {_NO_INDENTS}"
        " UNION ALL SELECT doc_id, para_ix, 'figure_caption_position', 'error' FROM anchors WHERE NOT anchored UNION ALL SELECT doc_id, para_ix, 'figure_caption_prefix', 'error' FROM p WHERE caption_kind = 'figure' AND caption_prefix <> 'Рисунок'"
        f" UNION ALL SELECT doc_id, para_ix, 'figure_caption_separator', 'error' FROM p WHERE caption_kind = 'figure' AND NOT {_DASH} UNION ALL SELECT doc_id, para_ix, 'table_title_keep', 'error' FROM p WHERE caption_kind = 'table' AND NOT (keep_with_next AND keep_together)"
        " UNION ALL SELECT doc_id, para_ix, 'table_caption_terminal_dot', 'error' FROM p WHERE caption_kind = 'table' AND text NOT LIKE '%.' UNION ALL SELECT doc_id, para_ix, 'image_max_px', 'warning' FROM i WHERE greatest(width_px, height_px) > 1100 UNION ALL SELECT doc_id, para_ix, 'image_format', 'warning' FROM i WHERE lower(extension) NOT IN ('png', 'jpg')"
        " UNION ALL SELECT doc_id, para_ix, 'image_after_first_reference', CASE WHEN para_ix IS NULL THEN 'error' ELSE 'warning' END FROM c1 RIGHT JOIN r1 USING (doc_id, number) WHERE para_ix IS NULL OR para_ix < ref_ix"
        " UNION ALL SELECT doc_id, para_ix, 'table_after_first_reference', CASE WHEN para_ix IS NULL THEN 'error' ELSE 'warning' END FROM c2 FULL JOIN r2 USING (doc_id, number) WHERE para_ix IS NULL OR ref_ix IS NULL OR para_ix < ref_ix"
        " UNION ALL SELECT doc_id, NULL, 'table_header_required', 'error' FROM t WHERE NOT has_header_row UNION ALL SELECT doc_id, NULL, 'table_title_position', 'error' FROM t WHERE title_para_ix IS NULL"
        " UNION ALL SELECT doc_id, min(para_ix), 'table_text_spacing_indent', 'error' FROM cells WHERE spaced OR indented OR turned GROUP BY doc_id, table_ix UNION ALL SELECT doc_id, min(para_ix), 'table_text_font_size', 'error' FROM cells WHERE font_size_pt NOT IN (12, 14) GROUP BY doc_id, table_ix"
        " UNION ALL SELECT doc_id, NULL, 'left_margin', 'error' FROM s WHERE left_margin_cm <> 3 UNION ALL SELECT doc_id, NULL, 'page_number_area', 'error' FROM s WHERE NOT has_page_number OR page_number_area <> 'footer'"
        " UNION ALL SELECT doc_id, NULL, 'required_document_structure', 'error' FROM d WHERE NOT (contains(whole, 'введение') AND contains(whole, 'итоги'))"
        " UNION ALL SELECT doc_id, para_ix, 'nbsp_after_figure_table_reference', 'error' FROM p WHERE regexp_matches(text, '(?i)(^|[^\\p{L}])(рис\\.|рисунок|табл\\.|таблица) \\d') UNION ALL SELECT doc_id, para_ix, 'font_color', 'error' FROM p WHERE color <> '000000' AND text <> ''), "
        "start AS (SELECT doc_id, coalesce(min(CASE WHEN text = 'Введение' THEN para_ix END), min(para_ix)) AS began FROM p WHERE paragraph_type = 'heading' AND heading_level = 1 GROUP BY doc_id), "
        "body AS (SELECT doc_id, para_ix, paragraph_type, min(CASE WHEN paragraph_type = 'main_text' THEN para_ix END) OVER (PARTITION BY doc_id) AS first FROM p WHERE text <> ''), before AS (SELECT *, max(para_ix) OVER (PARTITION BY doc_id) AS stop FROM body WHERE para_ix < first), lead AS (SELECT *, count(*) FILTER (paragraph_type = 'heading') OVER (PARTITION BY doc_id) AS n, count(*) FILTER (paragraph_type <> 'heading') OVER (PARTITION BY doc_id) AS other FROM before WHERE para_ix < stop), "
        "hidden AS (SELECT doc_id, para_ix FROM p JOIN start USING (doc_id) WHERE para_ix < began AND table_ix IS NULL UNION SELECT doc_id, para_ix FROM lead WHERE paragraph_type = 'heading' AND n >= 3 AND other = 0) "
        "SELECT doc_id, parameter, severity, count(*) AS n FROM found WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE hidden.doc_id = found.doc_id AND hidden.para_ix = found.para_ix) GROUP BY ALL"
    )
)
def whole_check(spark, sf_dir):
    """A profile of 24 rules of all families over whole documents: findings combined, filtered and counted."""
    blocks = whole_blocks(spark, sf_dir)
    return with_texts(findings_of(blocks, profile(spark, *CHECKED)).groupBy("doc_id", "parameter", "severity").agg(F.count("*").alias("n")), blocks.paragraphs)
