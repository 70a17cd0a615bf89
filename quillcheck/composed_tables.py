"""Queries over block tables, runs and lists of values that are composed from the order tables, with SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import corrections, derive, extraction
from quillcheck.registry import query
from quillcheck.sources import blocks, scan


def _of(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _duck(sql: str) -> str:
    return sql.replace("{lineitem}", "lineitem").replace("{orders}", "orders")


_PLACE = "SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, CAST(l_suppkey % 3 AS INT) AS table_ix, CAST(l_partkey % 4 AS INT) AS row_ix, CAST(l_linenumber AS INT) AS col_ix, CAST(floor(l_linenumber / 2.0) AS INT) AS cell_id, CAST(l_orderkey % 3 AS INT) AS pos, concat('t', l_quantity) AS text, CAST((l_orderkey + l_linenumber) % 4 AS INT) AS k FROM {lineitem}"
BODY = f"SELECT doc_id, pos * 8 + col_ix AS pos, text FROM ({_PLACE}) AS made WHERE k < 2"
CELLS = f"SELECT doc_id, table_ix, row_ix, col_ix, cell_id, pos, text FROM ({_PLACE}) AS made WHERE k = 2"
NOTES = f"SELECT doc_id, col_ix AS note_ix, pos, text FROM ({_PLACE}) AS made WHERE k = 3"


@query(
    f"""WITH c AS (SELECT *, min(col_ix) OVER (PARTITION BY doc_id, table_ix, row_ix, cell_id) AS first FROM ({_duck(CELLS)})),
u AS (SELECT doc_id, 0 AS k, NULL AS table_ix, NULL AS row_ix, NULL AS col_ix, NULL AS note_ix, pos, text FROM ({_duck(BODY)}) UNION ALL SELECT doc_id, 1, table_ix, row_ix, col_ix, NULL, pos, text FROM c WHERE col_ix = first UNION ALL SELECT doc_id, 2, NULL, NULL, NULL, note_ix, pos, text FROM ({_duck(NOTES)}))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, table_ix, row_ix, col_ix, note_ix, pos, text) - 1 AS INTEGER) AS para_ix, ['body', 'table_cell', 'footnote'][k + 1] AS kind, text, table_ix, row_ix, col_ix, note_ix FROM u"""
)
def scanned_blocks(spark, sf_dir):
    """Body, cells (merged ones once a row) and footnotes as one numbered sequence a document."""
    return scan.scanned(*(_of(spark, sf_dir, q, "lineitem") for q in (BODY, CELLS, NOTES)))


RUN_STYLES = """
SELECT doc_id, style_id, CASE style_id WHEN 'Normal' THEN x % 3 = 0 WHEN 'Quote' THEN true WHEN 'Strong' THEN CASE WHEN x % 2 = 0 THEN true END END AS bold, CASE WHEN style_id = 'Quote' THEN x % 5 = 0 END AS italic, CASE style_id WHEN 'Normal' THEN 14.0 WHEN 'Strong' THEN CASE WHEN x % 7 = 0 THEN 16.0 END END AS font_size_pt
FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, max(l_partkey) AS x FROM {lineitem} GROUP BY 1) AS docs, (SELECT 'Normal' AS style_id UNION ALL SELECT 'Quote' UNION ALL SELECT 'Strong') AS names"""
RUNS = """
SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, l_orderkey, l_linenumber, CASE l_suppkey % 5 WHEN 0 THEN 'Strong' WHEN 1 THEN ' Default Paragraph Font ' WHEN 2 THEN 'unknown' END AS char_style, CASE l_partkey % 3 WHEN 0 THEN 'Quote' WHEN 1 THEN 'Normal' END AS style_id,
  CASE WHEN l_quantity > 40 THEN false WHEN l_quantity < 5 THEN true END AS bold, CASE WHEN l_tax > 0.07 THEN true END AS italic, CASE WHEN l_discount > 0.09 THEN 10.5 END AS font_size_pt, CASE WHEN l_suppkey % 4 = 0 THEN 'ff00aa' WHEN l_suppkey % 4 = 1 THEN 'ABCDEF' END AS color_value, CASE l_suppkey % 4 WHEN 0 THEN 'rgb' WHEN 1 THEN 'theme' WHEN 2 THEN 'auto' END AS color_kind,
  CASE l_linenumber % 4 WHEN 0 THEN '20' WHEN 1 THEN 'wide' WHEN 2 THEN '-5' END AS character_spacing, concat('a', CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE ' ' END, 'b', CASE WHEN l_partkey % 6 = 0 THEN '  ' ELSE '' END) AS text
FROM {lineitem}"""


@query(
    f"""WITH st AS MATERIALIZED ({_duck(RUN_STYLES)}), r AS ({_duck(RUNS)}), j AS (SELECT r.*, c.bold AS cb, c.italic AS ci, c.font_size_pt AS cz, s.bold AS sb, s.italic AS si, s.font_size_pt AS sz, n.bold AS nb, n.italic AS ni, n.font_size_pt AS nz FROM r LEFT JOIN st c ON r.doc_id = c.doc_id AND r.char_style = c.style_id LEFT JOIN st s ON r.doc_id = s.doc_id AND r.style_id = s.style_id LEFT JOIN st n ON r.doc_id = n.doc_id AND n.style_id = 'Normal')
SELECT doc_id, l_orderkey, l_linenumber, lower(trim(coalesce(char_style, ''))) NOT IN ('', 'default paragraph font') AS has_character_style, coalesce(CAST(bold AS VARCHAR), CAST(italic AS VARCHAR), CAST(font_size_pt AS VARCHAR), color_value) IS NOT NULL AS has_direct_formatting, coalesce(bold, cb, sb, nb) AS bold, coalesce(italic, ci, si, ni) AS italic, CAST(coalesce(font_size_pt, cz, sz, nz) AS DOUBLE) AS font_size_pt,
  CASE color_kind WHEN 'auto' THEN '000000' WHEN 'rgb' THEN upper(color_value) END AS font_color, TRY_CAST(character_spacing AS INTEGER) AS character_spacing, CAST(length(text) - length(replace(text, ' ', '')) AS INTEGER) AS nonbreaking_space_count, contains(text, ' ') AS has_nonbreaking_space FROM j"""
)
def run_attributes(spark, sf_dir):
    """Runs with what holds: their own values, else their character style's, else their paragraph style's, else those of Normal."""
    runs = _of(spark, sf_dir, RUNS, "lineitem").withColumn("font_size_pt", F.col("font_size_pt").cast("double"))
    styles = _of(spark, sf_dir, RUN_STYLES, "lineitem").withColumn("font_size_pt", F.col("font_size_pt").cast("double"))
    names = ("doc_id", "l_orderkey", "l_linenumber", "has_character_style", "has_direct_formatting", "bold", "italic", "font_size_pt", "font_color", "character_spacing", "nonbreaking_space_count", "has_nonbreaking_space")
    return derive.run_effects(runs, styles).select(*names)


@query("""WITH b AS (SELECT o_orderkey AS doc_id, [CASE o_custkey % 4 WHEN 0 THEN 'page' WHEN 1 THEN NULL WHEN 2 THEN 'textWrapping' ELSE 'column' END] || CASE WHEN o_custkey % 5 = 0 THEN ['page'] ELSE [] END AS breaks, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 = 1 END AS mark FROM orders)
SELECT doc_id, len(list_filter(breaks, lambda x: coalesce(x, 'line') NOT IN ('page', 'column'))) > 0 AS has_line_break, list_contains(breaks, 'page') AS has_page_break, list_contains(breaks, 'column') AS has_column_break, coalesce(mark, false) AS has_section_break FROM b""")
def break_kinds(spark, sf_dir):
    """Which kinds of breaks a paragraph holds."""
    k = F.col("o_custkey") % 4
    first = F.array(F.when(k == 0, "page").when(k == 2, "textWrapping").when(k == 3, "column"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.concat(first, F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("page"))).otherwise(F.array().cast("array<string>"))).alias("breaks"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3 == 1).alias("has_section_mark"))
    return rows.select("doc_id", *derive.break_flags())


LISTS = "SELECT CAST(o_custkey % 50 AS STRING) AS source_document, CAST(l_orderkey AS BIGINT) AS ix, CASE WHEN o_custkey % 2 = 0 THEN 'main_text' END AS target, l_returnflag AS parameter, 'in' AS operator, 'mandatory' AS modality, CAST(l_quantity % 12 AS DOUBLE) AS v FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"


@query(
    f"""WITH r AS (SELECT source_document, ix, target, parameter, operator, modality, list_sort(list(DISTINCT v)) AS vs FROM ({_duck(LISTS)}) GROUP BY ALL), d AS MATERIALIZED (SELECT DISTINCT source_document, target, parameter, vs FROM r),
gone AS (SELECT DISTINCT a.source_document, a.target, a.parameter, a.vs FROM d a JOIN d b ON a.source_document = b.source_document AND a.target IS NOT DISTINCT FROM b.target AND a.parameter = b.parameter AND len(a.vs) < len(b.vs) AND list_has_all(b.vs, a.vs))
SELECT source_document, ix, target, parameter, array_to_string(list_transform(vs, lambda x: CAST(x AS INTEGER)), ' ') AS value_text FROM r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_document = r.source_document AND g.target IS NOT DISTINCT FROM r.target AND g.parameter = r.parameter AND g.vs = r.vs)"""
)
def longest_lists(spark, sf_dir):
    """Candidates with lists of values, without those that lie inside a longer list for the same target and parameter."""
    slot = ("source_document", "target", "parameter", "operator", "modality")
    rows = _of(spark, sf_dir, LISTS, "lineitem", "orders").groupBy(*slot, "ix").agg(F.array_sort(F.collect_set("v")).alias("value_list"))
    text = F.array_join(F.transform("value_list", C.number_text), " ")
    return extraction.without_subsets(rows, slot).select("source_document", "ix", "target", "parameter", text.alias("value_text"))


@query("""WITH p AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS ix, CAST(floor(l_quantity / 10) + 10 AS INTEGER) AS v FROM lineitem),
c AS (SELECT doc_id, v, count(*) AS n, min(ix) AS first, v BETWEEN 12 AND 13 AS ok FROM p GROUP BY ALL), m AS (SELECT doc_id, max(n) AS m FROM c GROUP BY doc_id),
a AS (SELECT doc_id, v FROM c WHERE ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first, CAST(v AS VARCHAR)) = 1), t AS (SELECT c.doc_id, CASE WHEN count(*) = 1 THEN min(v) END AS v FROM c JOIN m USING (doc_id) WHERE n = m GROUP BY c.doc_id)
SELECT t.doc_id, CAST(coalesce(a.v, t.v) AS VARCHAR) AS value FROM t LEFT JOIN a USING (doc_id)""")
def dominant_allowed(spark, sf_dir):
    """The value that a correction takes for main text: the most frequent allowed one, else the most frequent if none ties with it."""
    names = "profile_id string, ordinal int, target string, parameter string, operator string, value_num double, value_str string, value_bool boolean, value_list array<string>, consistency_strategy string"
    rules = spark.createDataFrame([("p", 0, "main_text", "font_size", "min", 12.0, None, None, None, None), ("p", 1, "main_text", "font_size", "max", 13.0, None, None, None, None)], names)
    styled = blocks.styled_of_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return corrections.dominant_allowed(styled, rules, ("font_size",)).select("doc_id", "value")
