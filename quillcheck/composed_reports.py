"""Queries over findings that are composed from order lines: comments at their anchors, cells by table, sections in order, with SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import formatting, violations
from quillcheck.registry import query


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _duck(sql: str) -> str:
    return sql.replace("{lineitem}", "lineitem")


FOUND = """
SELECT l_orderkey AS doc_id, 'p' AS profile_id, concat('r', l_partkey % 3) AS rule_id, CASE l_suppkey % 6 WHEN 0 THEN '4.10' WHEN 1 THEN '4.9' WHEN 2 THEN '4' WHEN 3 THEN 'Приложение' WHEN 4 THEN '' ELSE '10.2.1' END AS source_section, 'font_size' AS parameter,
  CASE WHEN l_linenumber = 5 THEN concat('Таблица ', l_suppkey % 2 + 1) ELSE concat('paragraph ', l_linenumber) END AS location, CASE WHEN l_linenumber <> 5 THEN CAST(l_linenumber AS INT) END AS paragraph_index, CAST(CASE WHEN l_linenumber = 4 THEN 1 END AS INT) AS table_index,
  concat(CASE WHEN l_partkey % 2 = 0 THEN 'п. 4.1: ' ELSE '' END, 'left_indent ', l_returnflag, ' justify') AS message, CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'warning' END AS severity, l_returnflag AS actual
FROM {lineitem}"""
PLACES = "SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS para_ix, CAST(CASE WHEN l_linenumber >= 6 THEN 0 END AS INT) AS table_ix FROM {lineitem}"
TABLES = "SELECT doc_id, table_ix, CASE WHEN (doc_id + table_ix) % 3 = 0 THEN 1 END AS title_para_ix, CASE WHEN (doc_id + table_ix) % 3 < 2 THEN 2 END AS paragraph_before_ix, CASE WHEN (doc_id + table_ix) % 5 > 0 THEN 9 END AS paragraph_after_ix FROM (SELECT DISTINCT l_orderkey AS doc_id FROM {lineitem}) AS d, (SELECT 0 AS table_ix UNION ALL SELECT 1) AS t"


@query(
    f"""WITH f AS ({_duck(FOUND)}), p AS ({_duck(PLACES)}), tab AS ({_duck(TABLES)}), placed AS (SELECT f.doc_id, source_section, severity, rule_id, paragraph_index, coalesce(table_index, p.table_ix, CASE WHEN location LIKE 'Таблица %' THEN CAST(location[9:] AS INTEGER) - 1 END) AS t, concat('левый отступ ', actual, ' по ширине') AS line FROM f LEFT JOIN p ON f.doc_id = p.doc_id AND paragraph_index = para_ix),
r AS (SELECT doc_id, t, CASE WHEN t IS NULL THEN paragraph_index END AS ix, source_section, severity, rule_id, count(*) AS n, min(paragraph_index) AS first_ix, list_sort(list(DISTINCT line)) AS lines FROM placed WHERE t IS NOT NULL OR paragraph_index IS NOT NULL GROUP BY ALL),
w AS (SELECT *, CASE WHEN t IS NOT NULL AND n > 1 THEN concat(lines[1], ' (', n, ')') ELSE array_to_string(lines, chr(10)) END AS text FROM r),
c AS (SELECT doc_id, t, ix, CAST(sum(n) AS BIGINT) AS n, min(first_ix) AS first_ix, string_agg(text, chr(10) ORDER BY source_section, severity, rule_id, text) AS comment FROM w GROUP BY doc_id, t, ix)
SELECT c.doc_id, t AS table_index, ix AS paragraph_index, n, comment, CAST(coalesce(CASE WHEN t IS NOT NULL THEN coalesce(title_para_ix, paragraph_before_ix, paragraph_after_ix) END, ix, first_ix, 0) AS INTEGER) AS anchor_ix FROM c LEFT JOIN tab ON c.doc_id = tab.doc_id AND t = tab.table_ix"""
)
def comment_texts(spark, sf_dir):
    """Comments of paragraphs and tables: cleaned text, number of findings, and the paragraph that they hang on."""
    found = violations.with_table(_of(spark, sf_dir, FOUND), _of(spark, sf_dir, PLACES))
    rows = violations.anchored(violations.comments(found), _of(spark, sf_dir, TABLES))
    return rows.select("doc_id", "table_index", "paragraph_index", "n", "comment", "anchor_ix")


@query(
    f"""WITH f AS ({_duck(FOUND)}), s AS (SELECT DISTINCT source_section AS s FROM f), k AS (SELECT s, list_transform(string_split(s, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS parts FROM s), o AS (SELECT s, CASE WHEN s = '' THEN 2 WHEN len(list_filter(parts, lambda x: x IS NULL)) = 0 THEN 0 ELSE 1 END AS rank, parts FROM k),
placed AS (SELECT s, row_number() OVER (ORDER BY rank, CASE WHEN rank = 0 THEN parts END, s) AS place FROM o), n AS (SELECT source_section AS s, count(*) AS n FROM f GROUP BY 1)
SELECT s AS source_section, CAST(place AS INTEGER) AS place, n, concat(n, CASE WHEN n % 100 BETWEEN 11 AND 14 THEN ' замечаний' WHEN n % 10 = 1 THEN ' замечание' WHEN n % 10 BETWEEN 2 AND 4 THEN ' замечания' ELSE ' замечаний' END) AS title FROM placed JOIN n USING (s)"""
)
def section_order(spark, sf_dir):
    """Sections in the order of their numbers, other names after them, with the number of their findings in words."""
    counts = violations.counts(_of(spark, sf_dir, FOUND), "source_section").withColumn("n", F.col("n_violations"))
    place = F.row_number().over(Window.orderBy(violations.section_key(F.col("source_section"))))  # one row a section
    title = F.concat_ws(" ", "n", C.plural(F.col("n"), "замечание", "замечания", "замечаний"))
    return counts.select("source_section", place.alias("place"), "n", title.alias("title"))


@query(
    f"""WITH f AS (SELECT * FROM ({_duck(FOUND)}) WHERE paragraph_index >= 3), c AS (SELECT doc_id, rule_id, paragraph_index % 2 AS t, actual, count(*) AS n, min(paragraph_index) AS ix FROM f GROUP BY ALL)
SELECT doc_id, rule_id, CAST(t AS INTEGER) AS table_index, CAST(sum(n) AS BIGINT) AS n_cells, min(ix) AS first_ix FROM c GROUP BY ALL"""
)
def cells_by_table(spark, sf_dir):
    """Findings of cells as one row a table and rule."""
    found = _of(spark, sf_dir, FOUND).where("paragraph_index >= 3").withColumn("table_index", (F.col("paragraph_index") % 2).cast("int"))
    return formatting.grouped_cells(found).select("doc_id", "rule_id", "table_index", "n_cells", "first_ix")
