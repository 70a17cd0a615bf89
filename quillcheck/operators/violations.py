"""Findings: their common schema, filters, counts, groups and comment texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.functions import fixed

COLUMNS = ("doc_id", "profile_id", "rule_id", "source_section", "target", "parameter", "location", "paragraph_index", "section_index", "table_index", "expected", "actual", "message", "severity", "violation_type")


def severity(default: str | Column = "error") -> Column:
    """Recommended rules warn, whatever the check says."""
    base = F.lit(default) if isinstance(default, str) else default
    return F.when(F.col("modality") == "recommended", "warning").otherwise(base)


def findings(df: DataFrame, expected: Column, actual: Column, level: str | Column = "error", section: Column | None = None, table: Column | None = None, paragraph: Column | None = None) -> DataFrame:
    """Rows of the common schema; df has doc_id, the rule's columns, and para_ix unless paragraph is given."""
    none = F.lit(None).cast("int")
    at = paragraph if paragraph is not None else (F.col("para_ix").cast("int") if "para_ix" in df.columns else none)
    section, table = section if section is not None else none, table if table is not None else none
    place = F.when(at.isNotNull(), F.concat(F.lit("paragraph "), at)).when(table.isNotNull(), F.concat(F.lit("table "), table + 1)).when(section.isNotNull(), F.concat(F.lit("section "), section + 1)).otherwise(F.lit("document"))
    sev = severity(level)
    return df.select(
        "doc_id", "profile_id", "rule_id", "source_section", "target", "parameter", place.alias("location"), at.cast("int").alias("paragraph_index"), section.cast("int").alias("section_index"), table.cast("int").alias("table_index"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"),
        F.concat_ws("", F.col("parameter"), F.lit(": found "), actual.cast("string"), F.lit(", expected "), expected.cast("string")).alias("message"), sev.alias("severity"), F.when(sev == "warning", "recommendation").otherwise(F.coalesce("category", F.lit("formatting"))).alias("violation_type"),
    )


def combined(families: list[DataFrame]) -> DataFrame:
    """All findings, with family_ord, the place of the family that found them."""
    parts = [f.select(*COLUMNS).withColumn("family_ord", F.lit(i)) for i, f in enumerate(families)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_suppressed(violations: DataFrame) -> DataFrame:
    return violations.where(~F.col("parameter").isin(*fixed.SUPPRESSED_PARAMETERS))


CONSISTENCY_SECTION = "4.1"


def without_consistency_duplicates(violations: DataFrame, section: str = CONSISTENCY_SECTION) -> DataFrame:
    """Findings of the consistency section go where another section has one for the same paragraph and parameter."""
    of_section = F.coalesce(F.col("source_section") == section, F.lit(False))
    place = ("doc_id", "profile_id", "paragraph_index", "parameter")
    known = F.lit(True)
    for c in place:
        known = known & F.col(c).isNotNull()
    other = F.bool_or(~of_section).over(Window.partitionBy(*place))
    return violations.withColumn("_c", other).where(~(of_section & known & F.col("_c"))).select(*violations.columns)


def without_places(violations: DataFrame, paragraphs: DataFrame, tables: DataFrame | None = None, always: tuple[str, ...] = ("required_document_structure", "front_matter_page_numbers_hidden_until_intro")) -> DataFrame:
    """Drops findings on given paragraphs (doc_id, para_ix) and tables (doc_id, table_ix), but for parameters that are always kept."""
    out = _marked(violations, paragraphs.select("doc_id", F.col("para_ix").cast("int").alias("paragraph_index")), "paragraph_index", "_p")
    gone = F.col("_p")
    if tables is not None:
        out = _marked(out, tables.select("doc_id", F.col("table_ix").cast("int").alias("table_index")), "table_index", "_t")
        gone = gone | F.col("_t")
    return out.where(F.col("parameter").isin(*always) | ~gone).select(*violations.columns)


def _marked(rows: DataFrame, places: DataFrame, place: str, out: str) -> DataFrame:
    """rows with out, whether their place is among places (doc_id, place). Both are put together and ranked by place instead of joined: that needs no shuffle where both are dealt by document, and no place is joined to null."""
    named = places.where(F.col("doc_id").isNotNull() & F.col(place).isNotNull()).withColumn("_place", F.lit(True))
    both = rows.unionByName(named, allowMissingColumns=True)
    return both.withColumn(out, F.max(F.coalesce("_place", F.lit(False))).over(Window.partitionBy("doc_id", place))).where("_place is null").drop("_place")


def with_table(violations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """table_index of each finding: its own, its paragraph's, else the number in the location text."""
    by = paragraphs.where("table_ix is not null").select("doc_id", F.col("para_ix").cast("int").alias("paragraph_index"), F.col("table_ix").cast("int").alias("_t"))
    text = F.regexp_extract("location", r"(?iU)(?:table|таблица)\s+(\d+)", 1).try_cast("int") - 1
    return violations.join(by, ["doc_id", "paragraph_index"], "left").withColumn("table_index", F.coalesce("table_index", "_t", text)).drop("_t").select(*violations.columns)


def front_matter(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_ix) before the introduction heading, or without one before the first level-1 heading of the main part."""
    heading = (F.col("paragraph_type") == "heading") & (F.col("heading_level") == 1)
    intro = heading & (F.col("logical_section") == "introduction")
    main = heading & (F.coalesce("is_numbered_heading", F.lit(False)) | (F.col("logical_section") == "main_part"))
    start = paragraphs.groupBy("doc_id").agg(F.coalesce(F.min(F.when(intro, F.col("para_ix"))), F.min(F.when(main, F.col("para_ix")))).alias("_start"))
    return paragraphs.join(start, "doc_id").where("para_ix < _start and table_ix is null").select("doc_id", "para_ix")


# Words of front-matter tables.
FRONT_TABLE_WORDS = (
    "министерство", "университет", "институт", "высшая школа", "кафедра", "направление подготовки", "профиль подготовки", "руководитель", "студент", "обучающийся", "выпускная квалификационная", "задание", "наименование института", "должность",
)


def front_matter_tables(paragraphs: DataFrame, words: tuple[str, ...] = FRONT_TABLE_WORDS, least: int = 2) -> DataFrame:
    """(doc_id, table_ix) of tables whose cells hold at least so many of the words."""
    found = [F.max(F.contains(C.normalised("text"), F.lit(w)).cast("int")).alias(f"_w{i}") for i, w in enumerate(words)]
    counts = paragraphs.where("table_ix is not null").groupBy("doc_id", "table_ix").agg(*found)
    return counts.where(sum(F.col(f"_w{i}") for i in range(len(words))) >= least).select("doc_id", "table_ix")


def leading_contents(paragraphs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, para_ix) of headings that stand, with nothing else, before the row that opens the first main text."""
    body = paragraphs.where(C.not_blank("text"))
    first = body.groupBy("doc_id").agg(F.min(F.when(F.col("paragraph_type") == "main_text", F.col("para_ix"))).alias("_text"))
    before = body.join(first, "doc_id").where(F.col("para_ix") < F.col("_text")).withColumn("_start", F.max("para_ix").over(Window.partitionBy("doc_id"))).where(F.col("para_ix") < F.col("_start"))
    heading = F.col("paragraph_type") == "heading"
    whole = Window.partitionBy("doc_id")
    ranked = before.withColumn("_n", F.count_if(heading).over(whole)).withColumn("_other", F.count_if(~heading & (F.col("paragraph_type") != "title_page")).over(whole))
    return ranked.where(heading & (F.col("_n") >= least) & (F.col("_other") == 0)).select("doc_id", "para_ix")


def counts(violations: DataFrame, *keys: str) -> DataFrame:
    """n_violations, n_errors, n_warnings, has_violations for each key, or in total."""
    grouped = violations.groupBy(*keys) if keys else violations.groupBy()
    return grouped.agg(F.count("*").alias("n_violations"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), (F.count("*") > 0).alias("has_violations"))


def section_key(section: Column) -> Column:
    """Sorts section numbers by their parts; other texts after them, empty ones last."""
    parts = F.transform(F.split(section, r"\."), lambda x: x.try_cast("int"))
    plain = F.forall(parts, lambda x: x.isNotNull())
    return F.struct(F.when(section.isNull() | (section == ""), 2).when(plain, 0).otherwise(1).alias("rank"), F.when(plain, parts).alias("parts"), section.alias("text"))


def violation_order() -> list[Column]:
    rank = F.when(F.col("paragraph_index").isNotNull(), 0).when(F.col("section_index").isNotNull(), 1).otherwise(2)
    return [rank, F.coalesce("paragraph_index", "section_index", F.lit(0)), F.col("location")]


#: Paragraph numbers, and locations, that a group of findings shows.
MOST_INDEXES, MOST_PLACES = 12, 8


def least_of(rows: DataFrame, keys: list[str], column: str, most: int, out: str) -> DataFrame:
    """keys and out: the least different values of a column in each group, in order, one more than most where there are as many.

    Values are made different first, spread over the tasks by group and value; then each task passes on so many of a group at
    most, and they are ranked again together. No task ever holds the values of a group.
    """
    ranked = rows.where(F.col(column).isNotNull()).select(*keys, column).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(column)))
    return ranked.where(F.col("_rank") <= most + 1).groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias(out))


def listed(values: Column, most: int) -> Column:
    """Values in order, cut off with dots."""
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(F.size(values) > most, "...").otherwise(""))


def grouped(violations: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each section and rule: counts, what was found and expected, where (paragraph numbers, else locations), first message."""
    one = lambda c: F.when(F.min(c) != F.max(c), F.lit("different")).otherwise(F.min(c))
    order = F.struct(*(e.alias(f"o{i}") for i, e in enumerate(violation_order())))
    of = [*keys, "source_section", "rule_id"]
    found = violations.withColumn("source_section", F.coalesce("source_section", F.lit("")))
    rows = found.groupBy(*of).agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        one("actual").alias("actual"), one("expected").alias("expected"), F.min_by("message", order).alias("message"),
    )
    numbers = least_of(found, of, "paragraph_index", MOST_INDEXES, "_numbers")
    places = least_of(found.where("paragraph_index is null"), of, "location", MOST_PLACES, "_places")
    for more in (numbers, places):
        more = more.select(*(F.col(k).alias(f"_{k}") for k in of), more.columns[-1])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in of]
        rows = rows.join(more, reduce(lambda a, b: a & b, same), "left").drop(*(f"_{k}" for k in of))
    shown = F.coalesce(listed(F.col("_numbers"), MOST_INDEXES), listed(F.col("_places"), MOST_PLACES), F.lit(""))
    total = Window.partitionBy(*keys, "source_section")
    return rows.withColumn("places", shown).drop("_numbers", "_places").withColumn("section_n", F.sum("n").over(total)).withColumn("section_rules", F.count("*").over(total))


# Fixed values: (technical, readable), in the order in which they are replaced.
CLEANED = (
    ("line_spacing", "межстрочный интервал"), ("first_line_indent", "абзацный отступ"), ("left_indent", "левый отступ"), ("right_indent", "правый отступ"), ("keep_with_next", "не отрывать от следующего"), ("keep_together", "не разрывать абзац"), ("tblHeader", "повторять строку с названиями столбцов"), ("center", "по центру"),
    ("justify", "по ширине"), ("left", "по левому краю"), ("right", "по правому краю"), ("000000", "чёрный"), ("True", "да"), ("False", "нет"), ("None", "не задано"), ("not set", "не задано"),
)


def cleaned(text: Column) -> Column:
    for old, new in CLEANED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(text)


def clean_message(text: Column) -> Column:
    """Without the number of a section in front."""
    return F.regexp_replace(cleaned(text), r"(?iU)^\s*(?:п\.|section|раздел)\s*\d+(?:\.\d+)*[.:]?\s*", "")


def report_rows(violations: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Numbered rows of a document's report in reading order, with the parameter's label and cleaned values."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*violation_order(), "rule_id", "actual"))
    rows = violations.withColumn("number", number)
    rows = rows.join(F.broadcast(parameters.select("parameter", "label")), "parameter", "left") if parameters is not None else rows.withColumn("label", F.lit(None).cast("string"))
    return rows.select("doc_id", "number", "location", F.coalesce("label", C.parameter_label("parameter")).alias("label"), cleaned(F.col("expected")).alias("expected"), cleaned(F.col("actual")).alias("actual"), clean_message(F.col("message")).alias("message"), "severity")


def comments(violations: DataFrame) -> DataFrame:
    """One comment for each paragraph or table that has findings: its text, one line a finding, or for tables one a rule with its count."""
    placed = violations.where("paragraph_index is not null or table_index is not null")
    line = clean_message(F.col("message"))
    by_rule = placed.groupBy("doc_id", "table_index", F.when(F.col("table_index").isNull(), F.col("paragraph_index")).alias("paragraph_index"), "source_section", "severity", "rule_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(line)).alias("lines"), F.min("paragraph_index").alias("first_ix"))
    text = F.when(F.col("table_index").isNotNull() & (F.col("n") > 1), F.concat(F.element_at("lines", 1), F.lit(" ("), F.col("n"), F.lit(")"))).otherwise(F.array_join("lines", "\n"))
    lists = by_rule.groupBy("doc_id", "table_index", "paragraph_index").agg(F.sum("n").alias("n"), F.min("first_ix").alias("first_ix"), F.sort_array(F.collect_list(F.struct("source_section", "severity", "rule_id", text.alias("text")))).alias("t"))
    return lists.select("doc_id", "table_index", "paragraph_index", "n", "first_ix", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("comment"))


def anchored(comment_rows: DataFrame, tables: DataFrame) -> DataFrame:
    """anchor_ix: a table's caption, else the paragraph before it, else after; else the comment's own paragraph, or the first."""
    t = tables.select("doc_id", F.col("table_ix").cast("int").alias("table_index"), F.coalesce("title_para_ix", "paragraph_before_ix", "paragraph_after_ix").cast("int").alias("_a"))
    return comment_rows.join(t, ["doc_id", "table_index"], "left").withColumn("anchor_ix", F.coalesce(F.when(F.col("table_index").isNotNull(), F.col("_a")), "paragraph_index", "first_ix", F.lit(0))).drop("_a")
