"""Queries over regulations composed from orders: extraction of rules, and what readers see of it, with SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import extraction
from quillcheck.registry import query

#: Statements, each under a numbered line of its own; {s}, {a}, {b}, {p}, {q}, {d} and {r} are numbers of the order.
STATEMENTS = (
    "Основной текст должен иметь кегль {s} пт.", "Основной текст следует набирать шрифтом Arial.", "Межстрочный интервал основного текста должен быть полуторным.", "Поля страницы: сверху — {a} см, снизу — {b} см.", "Абзацный отступ основного текста — 1,25 см.", "Размер шрифта в таблицах допускается {p} или {q} пт.", "Дополнительный текст: кегль на 2 пункта меньше.",
    "Выравнивание заголовков 1-го уровня по центру обязательно.", "Интервал перед заголовком 2-го уровня: перед — {d} пт.", "Не допускается курсив в тексте.", "Формат листа — А4 (210).", "Кегль основного текста 12-14 пт.", "Примечание: кегль 10 пт.", "В списке должно быть не менее {r} источников.", "Заголовки на английском языке: недопустимо.", "Название таблицы размещают над таблицей слева.",
)
#: Of each statement: target, parameter, operator, value, modality, status, confidence.
FOUND = (
    (0, "main_text", "font_size", "equals", "{s}", "mandatory", "extracted", 1.0), (1, "main_text", "font_family", "equals", "Arial", "recommended", "extracted", 1.0), (2, "main_text", "line_spacing", "equals", "1.5", "mandatory", "extracted", 1.0), (3, "page", "top_margin", "equals", "{a}", "mandatory", "extracted", 1.0), (3, "page", "bottom_margin", "equals", "{b}", "mandatory", "extracted", 1.0),
    (4, "main_text", "first_line_indent", "equals", "1.25", "mandatory", "extracted", 1.0), (5, "table_cell", "font_size", "in", "{p} / {q}", "allowed", "extracted", 1.0), (6, "point_heading", "font_size", "equals", "2", "mandatory", "needs_review", 0.7), (6, "point_heading", "font_size", "equals", "на 2 пункта меньше", "mandatory", "unsupported", 0.45),
    (7, "section_heading", "alignment", "equals", "center", "mandatory", "extracted", 1.0), (8, "subsection_heading", "space_before", "equals", "{d}", "mandatory", "extracted", 1.0), (10, "page", "page_format", "equals", "A4", "mandatory", "extracted", 1.0), (11, "main_text", "font_size", "equals", "14", "mandatory", "extracted", 1.0), (11, "main_text", "font_size", "min", "12", "mandatory", "extracted", 1.0),
    (11, "main_text", "font_size", "max", "14", "mandatory", "extracted", 1.0), (13, "document", "references_min_count", "equals", "{r}", "mandatory", "extracted", 1.0), (14, "document", "heading_english_not_allowed", "equals", "true", "mandatory", "extracted", 1.0), (15, "document", "table_caption_position", "equals", "above", "mandatory", "extracted", 1.0),
)
_NUMBERS = ("s", "a", "b", "p", "q", "d", "r")


def _filled(form: str) -> str:
    text = form
    for n in _NUMBERS:
        text = text.replace("{" + n + "}", f"', {n}, '")
    return f"concat('{text}', '')"


ROWS = f"""
SELECT CAST(doc AS STRING) AS source_document, ix, CAST((x + y) % {len(STATEMENTS)} AS INT) AS form, CAST(10 + x % 4 AS STRING) AS s, CAST(1 + x % 3 AS STRING) AS a, CAST(1 + y % 3 AS STRING) AS b, CAST(8 + x % 3 AS STRING) AS p, CAST(12 + y % 3 AS STRING) AS q, CAST(6 + x % 3 AS STRING) AS d, CAST(15 + y % 4 AS STRING) AS r
FROM (SELECT o_custkey AS doc, o_orderkey AS ix, o_orderkey * 7 + o_custkey AS x, CAST(floor(o_totalprice) AS BIGINT) AS y FROM {{orders}}) AS made"""
BLOCKS = f"""
WITH rows AS ({ROWS}) SELECT source_document, ix * 2 AS block_ix, concat('4.', CAST(ix + 1 AS STRING), '  Общее') AS text FROM rows
UNION ALL SELECT source_document, ix * 2 + 1, CASE form {" ".join(f"WHEN {i} THEN {_filled(f)}" for i, f in enumerate(STATEMENTS))} END FROM rows"""


def _duck(sql: str) -> str:
    return sql.replace("{lineitem}", "lineitem").replace("{orders}", "orders")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BLOCKS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _found() -> str:
    each = " UNION ALL ".join(f"SELECT source_document, ix, {k} AS place, '{t}' AS target, '{p}' AS parameter, '{o}' AS operator, {_filled(v)} AS value_text, '{m}' AS modality, '{s}' AS status, {c} AS confidence FROM rows WHERE form = {f}" for k, (f, t, p, o, v, m, s, c) in enumerate(FOUND))
    return f"""rows AS ({_duck(ROWS)}), every AS ({each}), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY source_document, target, parameter, operator, value_text ORDER BY ix, place) = 1),
counted AS (SELECT *, list_unique(list(CASE WHEN operator = 'equals' AND status <> 'unsupported' THEN value_text END) OVER (PARTITION BY source_document, target, parameter)) > 1 AS many FROM once),
found AS (SELECT source_document, ix, place, target, parameter, operator, value_text, modality, CASE WHEN many AND operator = 'equals' AND status <> 'unsupported' THEN 'conflict' ELSE status END AS status, CAST(confidence AS DOUBLE) AS confidence FROM counted)"""


@query(f"WITH {_found()} SELECT source_document, target, parameter, operator, value_text, modality, status, confidence FROM found")
def regulation_candidates(spark, sf_dir):
    """The whole extraction: sections, fragments, statements, candidates, structural candidates, checks and conflicts."""
    return extraction.extracted(blocks(spark, sf_dir)).select("source_document", "target", "parameter", "operator", "value_text", "modality", "status", "confidence")


@query(f"WITH {_found()} SELECT source_document, target AS target_group, count(*) AS n, count(*) FILTER (status NOT IN ('unsupported', 'conflict')) AS n_acceptable, string_agg(CASE WHEN status NOT IN ('unsupported', 'conflict') THEN parameter END, ' ' ORDER BY parameter, value_text) AS acceptable FROM found GROUP BY ALL")
def regulation_views(spark, sf_dir):
    """What readers see of the candidates, by target."""
    rows = extraction.views(extraction.extracted(blocks(spark, sf_dir)))
    names = F.transform(F.sort_array(F.filter("candidates", lambda c: c["can_accept"])), lambda c: F.element_at(F.split(c["rule"], " "), 1))
    text = F.array_join(F.array_sort(names), " ")
    return rows.select("source_document", "target_group", "n", "n_acceptable", F.when(text != "", text).alias("acceptable"))


@query(f"WITH {_found()}, yes AS (SELECT *, status <> 'unsupported' AND target IN ('main_text', 'page') AS ok FROM found) SELECT source_document AS profile_id, CAST(row_number() OVER (PARTITION BY source_document ORDER BY ix, place) - 1 AS INTEGER) AS ordinal, 'formatting' AS category, target, parameter, operator, modality, value_text FROM yes WHERE ok")
def regulation_profiles(spark, sf_dir):
    """Candidates for main text and pages accepted; the rules of the profiles that come of it."""
    rows = extraction.extracted(blocks(spark, sf_dir))
    accepted = rows.where("target in ('main_text', 'page')").select("source_document", "id")
    rules = extraction.profile_rules(extraction.confirmed(rows, accepted))
    value = F.coalesce(F.array_join("value_list", " / "), C.number_text("value_num"), "value_str")
    return rules.select("profile_id", F.col("ordinal").cast("int").alias("ordinal"), "category", "target", "parameter", "operator", "modality", value.alias("value_text"))


#: Rows of pages: contents pages, running text that goes on, small print.
PAGE_ROWS = """
SELECT CAST(doc AS STRING) AS source_document, ix AS block_ix, CAST(floor(ix / 6.0) AS INT) AS page_number, CASE WHEN x % 5 = 0 THEN 12.0 ELSE 14.0 END AS font_size, v,
  CASE v WHEN 0 THEN 'Содержание' WHEN 1 THEN 'Первая часть предло-' WHEN 2 THEN 'жения стоит тут' WHEN 3 THEN 'и кончается здесь.' WHEN 4 THEN '2.1 Поля страниц' WHEN 5 THEN '— пункт списка' WHEN 6 THEN '12 федер. агентство' WHEN 7 THEN 'Введение ..... 5' WHEN 8 THEN '17' ELSE 'Обычная  строка' END AS text
FROM (SELECT doc, ix, x, CAST((x + y) % 12 AS INT) AS v FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc, CAST((l_orderkey % 3) * 8 + l_linenumber AS INT) AS ix, max(l_partkey) AS x, max(l_suppkey) AS y FROM {lineitem} GROUP BY 1, 2) AS made) AS numbered"""


@query(
    f"""WITH RECURSIVE raw AS ({_duck(PAGE_ROWS)}), typed AS (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS t, CASE v WHEN 8 THEN 'page_number' WHEN 7 THEN 'toc' WHEN 5 THEN 'list_item' ELSE 'paragraph' END AS block_type FROM raw WHERE NOT (font_size <= 12.5 AND v = 6)),
kept AS (SELECT *, row_number() OVER (PARTITION BY source_document ORDER BY block_ix) AS n FROM typed WHERE (source_document, page_number) NOT IN (SELECT (source_document, page_number) FROM typed WHERE v = 0)),
marked AS (SELECT *, CASE WHEN block_type = 'paragraph' AND lag(block_type) OVER o = 'paragraph' AND lag(page_number) OVER o = page_number AND v <> 4 AND NOT regexp_matches(lag(t) OVER o, '[.:;!?]$') THEN 0 ELSE 1 END AS new FROM kept WINDOW o AS (PARTITION BY source_document ORDER BY n)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY source_document ORDER BY n) AS g FROM marked),
joined AS (SELECT source_document, g, min(block_type) AS block_type, string_agg(t, ' ' ORDER BY n) AS t FROM grouped GROUP BY ALL)
SELECT source_document, CAST(g - 1 AS INTEGER) AS block_ix, block_type, replace(t, '- ', '') AS text FROM joined"""
)
def page_rows_joined(spark, sf_dir):
    """Rows of pages without contents pages and small print, paragraphs that go on joined to the one before."""
    rows = extraction.page_blocks(spark.sql(PAGE_ROWS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).drop("v"))
    return rows.select("source_document", "block_ix", "block_type", "text")
