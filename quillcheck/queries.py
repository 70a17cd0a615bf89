"""Registered queries over the given tables, and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import corrections, derive, documents, extraction, formatting, objects, typography, violations
from quillcheck.composed_text import hits_sql
from quillcheck.registry import query
from quillcheck.sources import blocks
from quillcheck.sources.staging import dealt, staged

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir) -> DataFrame:
    return blocks.paragraphs_of_documents(_table(spark, sf_dir, "documents"))


def _pages(spark, sf_dir) -> DataFrame:
    return derive.classified(blocks.blocks_of_pages(_table(spark, sf_dir, "pages")))


def _styled(spark, sf_dir) -> DataFrame:
    return blocks.styled_of_lineitem(_table(spark, sf_dir, "lineitem"))


def _styled_dealt(spark, sf_dir) -> DataFrame:
    return blocks.styled_of_lineitem(dealt(_table(spark, sf_dir, "lineitem"), "l_orderkey"))


def _rules(spark: SparkSession, *rows: tuple) -> DataFrame:
    """(rule_id, target, parameter, operator, number, text, list, unit, modality) as a profile."""
    made = [("p", r[0], i, "formatting", *r[1:4], r[4], r[5], None, r[6], r[7], r[8], str(i + 1), True) for i, r in enumerate(rows)]
    df = spark.createDataFrame(made, "profile_id string, rule_id string, ordinal int, category string, target string, parameter string, operator string, value_num double, value_str string, value_bool boolean, value_list array<string>, unit string, modality string, source_section string, enabled boolean")
    return df.withColumn("condition", F.expr("parse_json(null)")).withColumn("consistency_strategy", F.expr("""parse_json('{"alignment": {"preferred_value": "justify"}, "font_size": {"fallback_value": "12"}}')"""))


_LINES = "split AS (SELECT doc_id AS d, string_split(text, chr(10)) AS parts FROM documents), lines AS (SELECT d AS doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS para_ix, unnest(parts) AS text FROM split)"

#: Lines with the columns that the typography rules ask for; those of plain documents say nothing more.
_SCOPE = f"{_LINES.replace('lines AS', 'plain AS')}, lines AS (SELECT doc_id, para_ix, text, NULL AS v, CAST(NULL AS VARCHAR) AS paragraph_type, CAST(NULL AS VARCHAR) AS caption_kind FROM plain)"


@query(f"WITH {_SCOPE}, {hits_sql()}")
def typography_findings(spark, sf_dir):
    """Every typography pattern that a line breaks."""
    return typography.fragments(_lines(spark, sf_dir)).select("doc_id", "para_ix", "parameter", "fragment", "level")


@query(f"WITH {_SCOPE}, f AS (WITH {hits_sql()}), d AS (SELECT doc_id, count(*) AS n_violations, count(DISTINCT parameter) AS n_parameters, min(para_ix) AS first_ix FROM f GROUP BY doc_id) SELECT doc_id, n_violations, n_parameters, first_ix, rank() OVER (ORDER BY n_violations DESC) AS worst FROM d QUALIFY worst <= 50")
def worst_documents(spark, sf_dir):
    """Documents by their number of findings, the worst first; a top-k report."""
    per = staged(typography.fragments(_lines(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_violations"), F.countDistinct("parameter").alias("n_parameters"), F.min("para_ix").alias("first_ix")), "worst")  # read twice
    # ranks of the counts that occur, which are few; a tie of any size is never in one task
    steps = per.groupBy("n_violations").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("n_violations")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = steps.select("n_violations", (above + 1).alias("worst")).where("worst <= 50")
    return per.join(ranks, "n_violations").select("doc_id", "n_violations", "n_parameters", "first_ix", "worst")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_documents(spark, sf_dir)


@query(f"WITH {_SCOPE}, {hits_sql(any_language=True)}")
def typography_all_patterns(spark, sf_dir):
    """Every typography pattern, look-around included, on all lines."""
    return typography.fragments(_lines(spark, sf_dir), any_language=True)


@query(f"""WITH {_SCOPE}, f AS (WITH {hits_sql(any_language=True)}), r AS (SELECT f.*, CASE parameter WHEN 'numeric_range_dash' THEN 'range' WHEN 'russian_quotes' THEN 'quotes' ELSE 'digits' END AS rule_id, CASE parameter WHEN 'numeric_range_dash' THEN '1' WHEN 'russian_quotes' THEN '2' ELSE '3' END AS source_section FROM f WHERE parameter IN ('numeric_range_dash', 'russian_quotes', 'digit_grouping_nbsp'))
SELECT doc_id, source_section, rule_id, count(*) AS n, count(*) FILTER (level = 'error') AS n_errors, count(*) FILTER (level = 'warning') AS n_warnings, CASE WHEN count(DISTINCT fragment) > 1 THEN 'different' ELSE min(fragment) END AS actual FROM r GROUP BY ALL""")
def typography_rule_findings(spark, sf_dir):
    """Findings in the common schema for a profile of three rules, counted and grouped by rule."""
    rules = _rules(spark, ("range", "document", "numeric_range_dash", "equals", None, None, None, None, "mandatory"), ("quotes", "document", "russian_quotes", "equals", None, None, None, None, "recommended"), ("digits", "document", "digit_grouping_nbsp", "equals", None, None, None, None, "mandatory"))
    df = derive.classified(_lines(spark, sf_dir)).withColumns({c: F.lit(None).cast("double") for c in ("first_line_indent_cm", "left_indent_cm", "right_indent_cm")} | {c: F.lit(None).cast("boolean") for c in ("has_formula_like_image", "is_standalone_equation", "has_equation", "has_line_break")} | {"alignment": F.lit(None).cast("string"), "logical_section": F.lit(None).cast("string")})
    found = staged(typography.check_paragraphs(df, rules, any_language=True), "typography-findings")  # three branches read them
    return violations.grouped(found).select("doc_id", "source_section", "rule_id", "n", "n_errors", "n_warnings", "actual")


_ELEMENTS = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"))


@query(f"SELECT page_id AS doc_id, CAST(len(regexp_extract_all(html, '(?is)(?:{_ELEMENTS})')) AS BIGINT) AS n_blocks FROM pages WHERE len(regexp_extract_all(html, '(?is)(?:{_ELEMENTS})')) > 0")
def page_blocks(spark, sf_dir):
    return blocks.blocks_of_pages(_table(spark, sf_dir, "pages")).groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


_BLOCKS = rf"""raw AS (SELECT page_id AS doc_id, regexp_extract_all(html, '(?is)(?:{_ELEMENTS})') AS parts FROM pages), each AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS para_ix, unnest(parts) AS raw FROM raw),
plain AS (SELECT doc_id, para_ix, lower(regexp_extract(raw, '^<(\w+)', 1)) AS tag, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS text FROM each),
parsed AS (SELECT *, CASE WHEN tag LIKE 'h_' THEN CAST(tag[2] AS INTEGER) END AS by_style, nullif(regexp_extract(text, '(?s)^(\d+(?:\.\d+)*)(?:\.\s*|\s+)(.+)$', 1), '') AS number, regexp_extract(text, '(?s)^(\d+(?:\.\d+)*)(?:\.\s*|\s+)(.+)$', 2) AS title,
  CASE WHEN tag = 'li' THEN true ELSE regexp_matches(text, '^(?:[—–]|-|[•▪▫‣]|\d+\)|\d+\.)\s+\S') END AS item FROM plain),
flagged AS (SELECT *, CASE WHEN number IS NOT NULL THEN len(number) - len(replace(number, '.', '')) + 1 END AS by_number, len(text) <= 160 AND NOT (len(string_split(text, ' ')) > 5 AND regexp_matches(text, '[.!?…]$')) AS styled,
  regexp_replace(regexp_replace(title, '([\p{{L}}\p{{N}}_])\.([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '([\p{{L}}\p{{N}}_])\.([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS bare FROM parsed),
typed AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN item THEN 'list_item' WHEN by_style IS NOT NULL AND (by_number IS NOT NULL OR styled) THEN 'heading' WHEN title <> '' AND len(text) <= 160 AND len(bare) - len(replace(bare, '.', '')) <= 1 THEN 'heading' ELSE 'main_text' END AS paragraph_type FROM flagged),
blocks AS (SELECT doc_id, para_ix, text, paragraph_type, CAST(CASE WHEN paragraph_type = 'heading' THEN coalesce(by_number, by_style) END AS INTEGER) AS heading_level, false AS is_structural_heading, paragraph_type = 'heading' AND by_number IS NOT NULL AS is_numbered_heading FROM typed)"""


@query(f"WITH {_BLOCKS} SELECT doc_id, para_ix, paragraph_type, heading_level, is_structural_heading, is_numbered_heading, CASE WHEN bool_or(coalesce(heading_level = 1, false)) OVER (PARTITION BY doc_id ORDER BY para_ix) THEN 'main_part' ELSE 'other' END AS logical_section FROM blocks")
def classified_pages(spark, sf_dir):
    """Type, level and logical section of every page block, title pages marked."""
    df = derive.prepared(blocks.blocks_of_pages(_table(spark, sf_dir, "pages")))
    return df.select("doc_id", "para_ix", "paragraph_type", "heading_level", "is_structural_heading", "is_numbered_heading", "logical_section")


@query(f"""WITH {_BLOCKS}, t AS (SELECT DISTINCT doc_id FROM blocks) SELECT 'heading_english_not_allowed' AS parameter, 'error' AS level, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM blocks WHERE paragraph_type = 'heading' AND regexp_matches(text, '[A-Za-z]') HAVING count(*) > 0
UNION ALL SELECT p, 'error', count(*), count(*) FROM t, (VALUES ('conclusion_required_content'), ('references_min_count')) v(p) GROUP BY p
UNION ALL SELECT 'required_document_structure', 'error', count(*), count(*) FROM t HAVING count(*) > 0""")
def page_heading_rules(spark, sf_dir):
    """Headings of pages that are English, and conclusions that are missing."""
    df = derive.prepared(blocks.blocks_of_pages(_table(spark, sf_dir, "pages")))
    return documents.structure_faults(df, required=["введение"], least_references=1).groupBy("parameter", "level").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@query(f"""WITH {_BLOCKS}, islands AS (SELECT *, sum(CASE WHEN paragraph_type = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY para_ix) AS list_ix, last_value(CASE WHEN text <> '' THEN len(text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks)
SELECT doc_id, CAST(list_ix AS BIGINT) AS list_ix, count(*) AS list_size, min(para_ix) AS first_ix, CAST(max(CASE WHEN place = 1 THEN before END) AS INTEGER) AS before_length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, list_ix ORDER BY para_ix) AS place FROM islands WHERE paragraph_type = 'list_item') GROUP BY doc_id, list_ix""")
def page_lists(spark, sf_dir):
    """Unbroken lists of pages with their size and the text above."""
    groups = typography.list_groups(_pages(spark, sf_dir))
    return groups.groupBy("doc_id", "list_ix").agg(F.max("list_size").alias("list_size"), F.min("para_ix").alias("first_ix"), F.max(F.length("before")).alias("before_length"))


_STYLED = """styled AS (SELECT l_orderkey AS doc_id, l_linenumber AS para_ix, CAST(floor(l_quantity / 10) + 10 AS DOUBLE) AS font_size_pt,
  CASE l_returnflag WHEN 'N' THEN 'justify' WHEN 'A' THEN 'left' ELSE 'center' END AS alignment, l_tax * 25 AS indent, 1 + round(l_discount * 10) / 10 AS line_spacing, l_linestatus = 'F' AS bold FROM lineitem)"""


@query(f"""WITH {_STYLED}, c AS (SELECT doc_id, font_size_pt AS main, count(*) AS n, min(para_ix) AS f FROM styled GROUP BY ALL)
SELECT doc_id, main, n AS main_count FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, main) = 1""")
def dominant_size(spark, sf_dir):
    return C.dominant(_styled(spark, sf_dir), ["doc_id"], "font_size_pt", "para_ix", "main").select("doc_id", "main", "main_count")


@query(f"""WITH {_STYLED} SELECT doc_id, para_ix, 'size' AS rule_id FROM styled WHERE abs(font_size_pt - 12) > 0.5
UNION ALL SELECT doc_id, para_ix, 'align' FROM styled WHERE alignment NOT IN ('justify', 'left')
UNION ALL SELECT doc_id, para_ix, 'indent' FROM styled WHERE indent > 1.25 + 0.05
UNION ALL SELECT doc_id, para_ix, 'spacing' FROM styled WHERE line_spacing < 1.05 - 0.05""")
def parameter_rules(spark, sf_dir):
    """Values that break a size, an alignment, an indent or a spacing rule."""
    rules = _rules(
        spark, ("size", "main_text", "font_size", "equals", 12.0, None, None, "pt", "mandatory"), ("align", "main_text", "alignment", "in", None, None, ["justify", "left"], None, "mandatory"),
        ("indent", "main_text", "first_line_indent", "max", 1.25, None, None, "cm", "mandatory"), ("spacing", "main_text", "line_spacing", "min", 1.05, None, None, "ratio", "recommended"),
    )
    df = _styled(spark, sf_dir).withColumns({"text": F.lit("x"), **{c: F.lit(None).cast("int") for c in ("heading_level", "table_ix", "table_row_ix", "table_col_ix")}, **{c: F.lit(None).cast("string") for c in ("caption_kind", "logical_section")}, "is_structural_heading": F.lit(False)})
    return formatting.check_parameters(df, rules).select("doc_id", F.col("paragraph_index").alias("para_ix"), "rule_id")


@query(f"""WITH {_STYLED} SELECT doc_id, 'alignment' AS parameter, alignment AS value, count(*) AS n, min(para_ix) AS first_ix FROM styled GROUP BY doc_id, alignment
UNION ALL SELECT doc_id, 'bold', CAST(bold AS VARCHAR), count(*), min(para_ix) FROM styled GROUP BY doc_id, bold""")
def value_counters(spark, sf_dir):
    return documents.value_counts(_styled(spark, sf_dir)).where("parameter in ('alignment', 'bold')").select("doc_id", "parameter", "value", "n", "first_ix")


@query(f"""WITH {_STYLED}, c AS (SELECT doc_id, font_size_pt AS v, count(*) AS n, min(para_ix) AS f FROM styled GROUP BY ALL), top AS (SELECT doc_id, v FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, CAST(CAST(v AS INTEGER) AS VARCHAR)) = 1),
chosen AS (SELECT doc_id, CASE WHEN v BETWEEN 11 AND 13 THEN v ELSE 12 END AS v FROM top), many AS (SELECT doc_id FROM styled GROUP BY doc_id HAVING count(*) >= 2)
SELECT s.doc_id, s.para_ix, 'font_size' AS parameter, CAST(CAST(font_size_pt AS INTEGER) AS VARCHAR) AS actual, CAST(CAST(v AS INTEGER) AS VARCHAR) AS expected FROM styled s JOIN many USING (doc_id) JOIN chosen USING (doc_id) WHERE font_size_pt <> v
UNION ALL SELECT s.doc_id, s.para_ix, 'alignment', alignment, 'justify' FROM styled s JOIN many USING (doc_id) WHERE alignment <> 'justify'""")
def consistency_findings(spark, sf_dir):
    """Main text off the value that its document should have: dominant if allowed, else fallback; profile value for alignment."""
    rules = _rules(spark, ("c", "main_text", "consistency", "consistent", None, None, None, None, "mandatory"), ("low", "main_text", "font_size", "min", 11.0, None, None, "pt", "mandatory"), ("high", "main_text", "font_size", "max", 13.0, None, None, "pt", "mandatory"))
    return documents.consistency_faults(_styled_dealt(spark, sf_dir), rules, ("font_size", "alignment")).select("doc_id", "para_ix", "parameter", "actual", "expected")


_SECTIONS = """sections AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS INTEGER) AS section_ix, max(CASE WHEN l_quantity < 30 THEN 3.0 ELSE 2.5 END) AS l, max(CASE WHEN l_tax > 0.06 THEN 1.0 ELSE 1.5 END) AS r FROM lineitem GROUP BY ALL)"""


def _sections(spark, sf_dir) -> DataFrame:
    keys = [F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("section_ix")]
    rows = dealt(_table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(*keys).agg(F.max(F.when(F.col("l_quantity") < 30, 3.0).otherwise(2.5)).alias("left_margin_cm"), F.max(F.when(F.col("l_tax") > 0.06, 1.0).otherwise(1.5)).alias("right_margin_cm"))
    return rows.withColumns({"top_margin_cm": F.lit(2.0), "bottom_margin_cm": F.lit(2.0), "page_width_cm": F.lit(21.0), "page_height_cm": F.lit(29.7)})


@query(f"""WITH {_SECTIONS}, p AS (SELECT *, r >= 1.2 AS valid FROM sections), total AS (SELECT doc_id, count(*) AS total FROM p GROUP BY doc_id HAVING count(*) >= 2),
c AS (SELECT doc_id, l, r, count(*) AS n, min(section_ix) AS f FROM p WHERE valid GROUP BY ALL), top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, l, r) = 1),
g AS (SELECT t.doc_id, CASE WHEN n > total / 2.0 THEN l ELSE 2.5 END AS gl, CASE WHEN n > total / 2.0 THEN r ELSE 2.5 END AS gr, CASE WHEN n > total / 2.0 THEN 2.0 ELSE 2.5 END AS gt FROM total t LEFT JOIN top USING (doc_id))
SELECT p.doc_id, section_ix FROM p JOIN g USING (doc_id) WHERE l <> gl OR r <> gr OR gt <> 2.0""")
def margin_findings(spark, sf_dir):
    """Sections whose margins are off the pattern of most sections, if that is valid, else off the fallback."""
    rules = _rules(spark, ("right", "page", "right_margin", "min", 1.2, None, None, "cm", "mandatory"))
    return documents.margin_consistency(_sections(spark, sf_dir), rules).select("doc_id", "section_ix")


@query(f"""WITH {_SECTIONS} SELECT doc_id, section_ix, 'left_margin' AS parameter, CASE WHEN l = 3.0 THEN '3 cm' ELSE '2.5 cm' END AS actual FROM sections WHERE abs(l - 3.0) > 0.05
UNION ALL SELECT doc_id, section_ix, 'right_margin', '1 cm' FROM sections WHERE r < 1.2 - 0.05""")
def section_rules(spark, sf_dir):
    rules = _rules(spark, ("l", "page", "left_margin", "equals", 3.0, None, None, "cm", "mandatory"), ("r", "page", "right_margin", "min", 1.2, None, None, "cm", "mandatory"))
    rows = _sections(spark, sf_dir).withColumns({c: F.lit(None).cast("double") for c in ("header_distance_cm", "footer_distance_cm")} | {c: F.lit(None).cast("string") for c in ("page_format", "page_orientation", "page_number_alignment")})
    return documents.check_sections(rows, rules).select("doc_id", F.col("section_index").alias("section_ix"), "parameter", "actual")


@query("""WITH c AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 50 AS VARCHAR) AS number, max(o_orderkey) AS para_ix FROM orders GROUP BY ALL), r AS (SELECT o_custkey AS doc_id, CAST(l_partkey % 50 AS VARCHAR) AS number, min(l_orderkey) AS ref_ix FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT doc_id, para_ix, concat(number, ': ', CASE WHEN para_ix IS NULL THEN 'caption missing' WHEN ref_ix IS NULL THEN 'never referred to' ELSE 'before its first reference' END) AS actual,
  CASE WHEN para_ix IS NULL THEN 'error' ELSE 'warning' END AS level FROM c FULL JOIN r USING (doc_id, number) WHERE para_ix IS NULL OR ref_ix IS NULL OR para_ix < ref_ix""")
def reference_integrity(spark, sf_dir):
    """Captions (orders) and references (their lines) of a document (a customer): missing, unreferenced, too early."""
    orders = _table(spark, sf_dir, "orders")
    captions = orders.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 50).cast("string").alias("number"), F.col("o_orderkey").alias("para_ix"))
    lines = _table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    references = lines.groupBy(F.col("o_custkey").alias("doc_id"), (F.col("l_partkey") % 50).cast("string").alias("number")).agg(F.min("l_orderkey").alias("ref_ix"))
    return objects.reference_faults(references, captions, "table_after_first_reference", True).select("doc_id", "para_ix", "actual", "level")


def _cells(spark, sf_dir) -> DataFrame:
    """Orders as documents whose lines are the cells of one table of two columns."""
    return _styled(spark, sf_dir).withColumns(
        {
            "table_ix": F.lit(0), "table_row_ix": F.expr("(para_ix - 1) div 2"), "table_col_ix": (F.col("para_ix") - 1) % 2, "text": F.col("font_family"), "left_indent_cm": F.lit(0.0), "right_indent_cm": F.lit(0.0),
            "paragraph_type": F.lit("table_cell"), "caption_kind": F.lit(None).cast("string"),
        }
    )


@query(f"""WITH {_STYLED}, c AS (SELECT *, (para_ix - 1) // 2 AS row_ix FROM styled), b AS (SELECT doc_id, para_ix, abs(line_spacing - 1) > 0.05 AS s, abs(indent) > 0.05 AS i, row_ix <> 0 AND alignment <> 'left' AS a FROM c)
SELECT doc_id, min(para_ix) AS para_ix, concat_ws(', ', CASE WHEN bool_or(a) THEN 'alignment' END, CASE WHEN bool_or(i) THEN 'indents' END, CASE WHEN bool_or(s) THEN 'line spacing' END) AS actual FROM b WHERE s OR i OR a GROUP BY doc_id""")
def table_cell_findings(spark, sf_dir):
    df = objects.cell_faults(_cells(spark, sf_dir))
    return df.where("parameter = 'table_text_spacing_indent'").select("doc_id", "para_ix", "actual")


@query("""SELECT l_orderkey AS doc_id, CAST(max((l_linenumber - 1) // 2) + 1 AS INTEGER) AS rows_count, CAST(max((l_linenumber - 1) % 2) + 1 AS INTEGER) AS columns_count, CAST(count(DISTINCT CASE WHEN l_quantity > 45 THEN (l_linenumber - 1) // 2 END) AS INTEGER) AS n_enlarged FROM lineitem GROUP BY 1""")
def table_rollup(spark, sf_dir):
    """Tables from their cells: size and enlarged rows."""
    cells = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_ix"), F.expr("cast((l_linenumber - 1) div 2 as int)").alias("row_ix"), ((F.col("l_linenumber") - 1) % 2).alias("col_ix"), F.col("l_linenumber").alias("cell_id"), F.lit("x").alias("text"), F.when(F.col("l_quantity") > 45, 800).otherwise(300).alias("row_height_twips"),
        F.lit(False).alias("cant_split"), F.lit(False).alias("repeats_header"), F.expr("array(named_struct('val', l_returnflag, 'color', 'auto', 'size', 4))").alias("borders"),
    )
    return derive.table_facts(cells).select("doc_id", "rows_count", "columns_count", F.size("enlarged_row_ix").alias("n_enlarged"))


_RUNS = """runs AS (SELECT o_custkey AS doc_id, o_orderkey AS para_ix, l_linenumber AS run_ix, CAST(floor(l_quantity / 10) + 10 AS DOUBLE) AS size, l_linestatus = 'F' AS underline, l_returnflag = 'R' AS caps, l_discount > 0.08 AS spaced FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _run_paragraphs(spark, sf_dir) -> DataFrame:
    """Orders as paragraphs of customers; their lines are the runs."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = lines.count()
    lines = dealt(lines, "l_orderkey", rows=n).join(dealt(orders, "o_orderkey", rows=n), F.col("l_orderkey") == F.col("o_orderkey"))
    run = F.struct(F.col("l_linenumber").alias("run_ix"), F.lit("text").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), (F.col("l_linestatus") == "F").alias("underline"), F.lit(False).alias("strike"), F.lit(False).alias("double_strike"), F.lit(False).alias("small_caps"), (F.col("l_returnflag") == "R").alias("all_caps"), (F.floor(F.col("l_quantity") / 10) + 10).cast("double").alias("font_size_pt"), F.lit("000000").alias("font_color"), F.when(F.col("l_discount") > 0.08, 20).otherwise(0).alias("character_spacing"), F.lit(False).alias("has_character_style"), F.lit(False).alias("has_direct_formatting"))
    return lines.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("para_ix")).agg(F.sort_array(F.collect_list(run)).alias("runs")).withColumns({"paragraph_type": F.lit("main_text"), "font_size_pt": F.col("runs")[0]["font_size_pt"]})


@query(f"""WITH {_RUNS}, c AS (SELECT doc_id, para_ix, size, count(*) AS n, min(run_ix) AS f FROM runs GROUP BY ALL), top AS (SELECT doc_id, para_ix, size AS top FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, para_ix ORDER BY n DESC, f, size) = 1)
SELECT doc_id, para_ix, CAST(CAST(top AS INTEGER) AS VARCHAR) AS expected FROM runs JOIN top USING (doc_id, para_ix) WHERE size <> top GROUP BY ALL""")
def mixed_run_sizes(spark, sf_dir):
    return formatting.mixed_sizes(_run_paragraphs(spark, sf_dir)).select("doc_id", "para_ix", "expected")


@query(f"""WITH {_RUNS} SELECT doc_id, para_ix, 'underline' AS parameter, count(*) AS n FROM runs WHERE underline GROUP BY ALL UNION ALL SELECT doc_id, para_ix, 'all_caps', count(*) FROM runs WHERE caps GROUP BY ALL UNION ALL SELECT doc_id, para_ix, 'character_spacing', count(*) FROM runs WHERE spaced GROUP BY ALL""")
def run_findings(spark, sf_dir):
    return formatting.run_faults(_run_paragraphs(spark, sf_dir)).groupBy("doc_id", "para_ix", "parameter").agg(F.count("*").alias("n"))


@query(f"""WITH {_RUNS}, w AS (SELECT doc_id, unnest([CASE WHEN underline THEN 'underline' END, CASE WHEN caps THEN 'all_caps' END, CASE WHEN spaced THEN 'character_spacing' END]) AS way FROM runs) SELECT doc_id, array_to_string(list_sort(list(DISTINCT way)), ', ') AS actual FROM w WHERE way IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT way) > 1""")
def emphasis_mixes(spark, sf_dir):
    return formatting.emphasis_methods(_run_paragraphs(spark, sf_dir)).select("doc_id", "actual")


@query("""SELECT p_partkey AS doc_id, CASE WHEN w <= 21.2 AND w >= 20.8 AND h BETWEEN 29.5 AND 29.9 THEN 'A4' WHEN w BETWEEN 14.6 AND 15.0 AND h BETWEEN 20.8 AND 21.2 THEN 'A5' WHEN w BETWEEN 29.5 AND 29.9 AND h BETWEEN 20.8 AND 21.2 THEN 'A4' ELSE 'other' END AS page_format, CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 21.1 WHEN 1 THEN 14.8 WHEN 2 THEN 29.7 ELSE 33.0 END AS w, CASE p_size % 4 WHEN 0 THEN 29.6 WHEN 1 THEN 21.0 WHEN 2 THEN 21.0 ELSE 12.0 END AS h FROM part)""")
def page_formats(spark, sf_dir):
    turn = F.col("p_size") % 4
    size = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(turn == 0, 21.1).when(turn == 1, 14.8).when(turn == 2, 29.7).otherwise(33.0).alias("w"), F.when(turn == 0, 29.6).when(turn == 1, 21.0).when(turn == 2, 21.0).otherwise(12.0).alias("h"))
    name = C.page_format("w", "h")
    return size.select("doc_id", F.when(name.rlike("^A[0-6]$"), name).otherwise("other").alias("page_format"), C.orientation("w", "h").alias("orientation"))


_FINDINGS = """f AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS ix, concat(CAST(l_suppkey % 3 + 1 AS VARCHAR), '.', CAST(l_suppkey % 12 AS VARCHAR)) AS section, CAST(l_partkey % 5 AS VARCHAR) AS rule, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'warning' END AS severity, l_returnflag AS actual FROM lineitem)"""


def _findings(spark, sf_dir, deal=lambda df, key: df) -> DataFrame:
    """Order lines as findings in documents."""
    none = F.lit(None)
    li = deal(_table(spark, sf_dir, "lineitem"), "l_orderkey")
    section = F.concat((F.col("l_suppkey") % 3 + 1).cast("string"), F.lit("."), (F.col("l_suppkey") % 12).cast("string"))
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit("p").alias("profile_id"), (F.col("l_partkey") % 5).cast("string").alias("rule_id"), section.alias("source_section"), F.lit("main_text").alias("target"), F.lit("font_size").alias("parameter"), F.concat(F.lit("paragraph "), F.col("l_linenumber")).alias("location"), F.col("l_linenumber").cast("int").alias("paragraph_index"),
        none.cast("int").alias("section_index"), none.cast("int").alias("table_index"), F.lit("x").alias("expected"), F.col("l_returnflag").alias("actual"), F.col("l_returnflag").alias("message"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"), F.lit("formatting").alias("violation_type"),
    )


@query(f"""WITH {_FINDINGS} SELECT doc_id, section AS source_section, rule AS rule_id, count(*) AS n, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
  CASE WHEN count(DISTINCT actual) > 1 THEN 'different' ELSE min(actual) END AS actual, array_to_string(list_sort(list(DISTINCT ix)), ', ') AS places, CAST(sum(count(*)) OVER (PARTITION BY doc_id, section) AS BIGINT) AS section_n FROM f GROUP BY doc_id, section, rule""")
def grouped_findings(spark, sf_dir):
    return violations.grouped(_findings(spark, sf_dir)).select("doc_id", "source_section", "rule_id", "n", "n_errors", "n_warnings", "actual", "places", "section_n")


@query("""WITH f AS (SELECT CAST(l_partkey % 5 AS VARCHAR) AS rule, l_suppkey % 3 AS s, CASE WHEN l_suppkey % 3 < 2 THEN CAST(l_orderkey AS INTEGER) END AS ix, concat('order ', l_orderkey) AS place, l_returnflag AS actual FROM lineitem),
ixs AS (SELECT rule, s, list_sort(list(DISTINCT ix)) AS v FROM f WHERE ix IS NOT NULL GROUP BY ALL), places AS (SELECT rule, s, list_sort(list(DISTINCT place)) AS v FROM f WHERE ix IS NULL GROUP BY ALL)
SELECT concat('1.', s) AS source_section, rule AS rule_id, count(*) AS n, CASE WHEN count(DISTINCT actual) > 1 THEN 'different' ELSE min(actual) END AS actual, CASE WHEN any_value(ixs.v) IS NOT NULL THEN concat(array_to_string(any_value(ixs.v)[1:12], ', '), CASE WHEN len(any_value(ixs.v)) > 12 THEN '...' ELSE '' END) ELSE concat(array_to_string(any_value(places.v)[1:8], ', '), CASE WHEN len(any_value(places.v)) > 8 THEN '...' ELSE '' END) END AS places,
  CAST(sum(count(*)) OVER (PARTITION BY s) AS BIGINT) AS section_n FROM f LEFT JOIN ixs USING (rule, s) LEFT JOIN places USING (rule, s) GROUP BY rule, s""")
def grouped_overall(spark, sf_dir):
    """All order lines as findings of one collection, in fifteen groups: the first places of groups that are as large as the table allows."""
    li = _table(spark, sf_dir, "lineitem")
    section, none = F.col("l_suppkey") % 3, F.lit(None)
    found = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit("p").alias("profile_id"), (F.col("l_partkey") % 5).cast("string").alias("rule_id"), F.concat(F.lit("1."), section).alias("source_section"), F.concat(F.lit("order "), F.col("l_orderkey")).alias("location"), F.when(section < 2, F.col("l_orderkey").cast("int")).alias("paragraph_index"),
        none.cast("int").alias("section_index"), F.lit("x").alias("expected"), F.col("l_returnflag").alias("actual"), F.col("l_returnflag").alias("message"), F.lit("error").alias("severity"),
    )
    return violations.grouped(found, keys=()).select("source_section", "rule_id", "n", "actual", "places", "section_n")


@query(f"""WITH {_FINDINGS} SELECT doc_id, count(*) AS n_violations, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, true AS has_violations FROM f GROUP BY doc_id""")
def severity_counts(spark, sf_dir):
    return violations.counts(_findings(spark, sf_dir), "doc_id")


@query(f"""WITH {_FINDINGS} SELECT doc_id, ix AS paragraph_index, count(*) AS n FROM f WHERE NOT (section = '1.0' AND EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.ix = f.ix AND g.section <> '1.0')) GROUP BY ALL""")
def comment_groups(spark, sf_dir):
    """Comments of paragraphs, after findings of the consistency section give way to others on the same paragraph."""
    rows = violations.without_consistency_duplicates(_findings(spark, sf_dir, dealt), section="1.0")
    return violations.comments(rows).select("doc_id", "paragraph_index", "n")


@query("""WITH o AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS para_ix, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS filled, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT doc_id, para_ix, CAST(filled AS BIGINT) AS filled, before AS before_length FROM o""")
def conversation_fill(spark, sf_dir):
    """Ordered blocks: the running number of user turns, and the length of the row above."""
    order = Window.partitionBy("doc_id").orderBy("para_ix")
    df = blocks.blocks_of_conversations(_table(spark, sf_dir, "conversations"))
    return df.select("doc_id", "para_ix", F.sum(F.when(F.col("style_name") == "user", 1).otherwise(0)).over(order).alias("filled"), F.lag(F.length("text")).over(order).cast("long").alias("before_length"))


@query(f"""WITH {_LINES} SELECT doc_id, para_ix, regexp_replace(regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '"([^"\\n]+)"', '«\\1»', 'g'), '^ +| +$', '', 'g') AS new_value FROM lines WHERE regexp_replace(regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '"([^"\\n]+)"', '«\\1»', 'g'), '^ +| +$', '', 'g') <> text""")
def corrected_text(spark, sf_dir):
    """Lines that the safe rewrites of three gates change."""
    return corrections.corrected_lines(_lines(spark, sf_dir), ("repeated_spaces", "russian_quotes", "paragraph_edge_spaces")).select("doc_id", "para_ix", "new_value")


@query()
def corrected_text_all_gates(spark, sf_dir):
    every = [p for gate, _ in corrections.REWRITES for p in gate] + ["paragraph_edge_spaces", "list_marker_dash_required"]
    return corrections.corrected_lines(_lines(spark, sf_dir), every)


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS para_ix, CAST(floor(l_quantity / 10) + 10 AS INTEGER) AS s FROM lineitem) SELECT doc_id, para_ix, CAST(s AS VARCHAR) AS old_value, CAST(least(greatest(s, 11), 13) AS VARCHAR) AS new_value FROM r WHERE s < 11 OR s > 13""")
def correction_plan(spark, sf_dir):
    """Sizes outside a rule's limits, with the limit that they go to."""
    rules = _rules(spark, ("low", "main_text", "font_size", "min", 11.0, None, None, "pt", "mandatory"), ("high", "main_text", "font_size", "max", 13.0, None, None, "pt", "mandatory"))
    df = _styled(spark, sf_dir).withColumn("text", F.lit("x"))
    return corrections.main_text_plan(df, rules).where("parameter = 'font_size'").select("doc_id", "para_ix", "old_value", "new_value")


@query(f"""WITH {_LINES}, t AS (SELECT CAST(doc_id AS VARCHAR) AS source_document, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM lines) SELECT source_document, CASE WHEN regexp_matches(text, '^\\d+$') THEN 'page_number' WHEN regexp_matches(text, '[.…·⋯]{{3,}}\\s*\\d+$') THEN 'toc' WHEN regexp_matches(text, '^([-−–—•▪▫‣]|\\d+[).]|[а-яА-Я][).])\\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type, count(*) AS n FROM t WHERE text <> '' GROUP BY ALL""")
def normative_blocks(spark, sf_dir):
    """Lines as blocks of a regulation, by type."""
    rows = _lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_document"), F.col("para_ix").alias("block_ix"), "text")
    return extraction.typed_blocks(rows).groupBy("source_document", "block_type").agg(F.count("*").alias("n"))


@query()
def extracted_candidates(spark, sf_dir):
    """The whole extraction over all documents read as regulations: candidates by target and parameter."""
    rows = _lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_document"), F.col("para_ix").alias("block_ix"), "text")
    return extraction.extracted(rows).groupBy("target", "parameter", "status").agg(F.count("*").alias("n"))


@query()
def notation_mixes(spark, sf_dir):
    """Documents that write phone numbers, powers or products in different ways."""
    return typography.notation_mixes(_lines(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT doc_id, para_ix, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_-])public\\s+license($|[^\\p{{L}}\\p{{N}}_-])') THEN 'public license' ELSE 'version' END AS phrase FROM lines WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_-])(public\\s+license|version)($|[^\\p{{L}}\\p{{N}}_-])')""")
def forbidden_phrases(spark, sf_dir):
    """First phrase of a list that a line holds as whole words."""
    df = _lines(spark, sf_dir).withColumns({"paragraph_type": F.lit("main_text"), "logical_section": F.lit("main_part"), "list_marker_type": F.lit(None).cast("string")})
    return documents.language_faults(df, phrases=["public license", "version"]).where("parameter = 'forbidden_phrases'").select("doc_id", "para_ix", F.col("actual").alias("phrase"))


@query(f"""WITH {_FINDINGS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ix, rule, actual) AS INTEGER) AS number, concat('paragraph ', ix) AS location, 'font size' AS label, actual, severity FROM f""")
def report_rows(spark, sf_dir):
    """Findings as the numbered rows of a report."""
    return violations.report_rows(_findings(spark, sf_dir)).select("doc_id", "number", "location", "label", "actual", "severity")


@query("WITH r AS (SELECT DISTINCT l_suppkey % 40 AS k FROM lineitem) SELECT k, CASE k % 8 WHEN 0 THEN 'left margin' WHEN 1 THEN 'font size' WHEN 2 THEN 'line spacing' WHEN 3 THEN 'image max px' WHEN 4 THEN 'table header required' WHEN 5 THEN 'heading spacing order' WHEN 6 THEN 'page number area' ELSE 'references min count' END AS label, CASE k % 8 WHEN 0 THEN 'cm' WHEN 1 THEN 'pt' WHEN 2 THEN 'ratio' WHEN 3 THEN 'px' END AS unit, CASE k % 8 WHEN 0 THEN 'page' WHEN 3 THEN 'image' WHEN 4 THEN 'table' WHEN 5 THEN 'heading' WHEN 6 THEN 'page' WHEN 7 THEN 'structure' ELSE 'text' END AS kind FROM r")
def parameter_registry(spark, sf_dir):
    """Labels, units and kinds of parameters."""
    names = ("left_margin", "font_size", "line_spacing", "image_max_px", "table_header_required", "heading_spacing_order", "page_number_area", "references_min_count")
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("k")).distinct()
    parameter = F.element_at(F.array(*map(F.lit, names)), (F.col("k") % 8 + 1).cast("int"))
    return rows.select("k", C.parameter_label(parameter).alias("label"), C.parameter_unit(parameter).alias("unit"), C.parameter_kind(parameter).alias("kind"))
