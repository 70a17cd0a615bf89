"""Corrections as tables: corrected texts, and plans of old and new values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.functions import fixed
from quillcheck.operators import documents as D
from quillcheck.operators.formatting import heading_sizes, long_values
from quillcheck.operators.typography import list_groups

_N = fixed.NBSP
_L = "A-Za-zА-Яа-яЁё"
_UNIT = "см|мм|м|км|г|кг|мг|л|мл|с|мин|ч|пт|К|K|Вт|кВт|Дж|кДж|Па|кПа|МПа|В|кВ|А|Гц|кГц|МГц|моль|%"
# Fixed values: (parameters that ask for it, [(pattern, replacement)]), in the order in which a run is rewritten.
REWRITES = (
    (("repeated_spaces",), ((r" {2,}", " "),)),
    (("spaces_near_punctuation", "spaces_inside_brackets_quotes"), ((r"(?U)\s+([.,;:!?])", "$1"), (r"(?U)([(\[{«„])\s+", "$1"), (r"(?U)\s+([)\]}»“])", "$1"))),
    (("number_sign_symbol", "number_sign_nbsp", "nbsp_after_number_sign"), ((r"(?iU)\b(?:N|No)\s*(\d+)", f"№{_N}$1"), (r"(?U)#\s*(\d+)", f"№{_N}$1"), (r"(?U)(№) (\d+)", f"$1{_N}$2"))),
    (("nbsp_after_paragraph_sign",), ((r"(?U)(§) (\d+)", f"$1{_N}$2"),)),
    (("nbsp_after_figure_table_reference",), ((r"(?iU)\b(рис\.|табл\.) (\d+)", f"$1{_N}$2"),)),
    (("nbsp_between_initials",), ((r"(?U)\b([А-ЯЁA-Z]\.) ([А-ЯЁA-Z]\.)", f"$1{_N}$2"), (rf"(?U)\b([А-ЯЁA-Z]\.{_N}[А-ЯЁA-Z]\.) ([А-ЯЁA-Za-zа-яё-]+)", f"$1{_N}$2"))),
    (("wrong_multiplication_symbols", "multiplication_symbol"), ((r"(?U)\b(\d+(?:[,.]\d+)?)\*(?=\d)", "$1×"), (r"(?U)(?<=\d)\s*[xX]\s*(?=\d)", "×"))),
    (("numeric_range_dash",), ((r"(?U)(?<![\w.])(\d+)\s*-\s*(\d+)(?![\w.])", "$1–$2"), (r"(?U)(?<![\w.])(\d+)\s+[–—]\s+(\d+)(?![\w.])", "$1–$2"))),
    (("hyphen_instead_of_dash", "dash_spacing"), ((rf"(?U)(?<=[{_L}])\s-\s(?=[{_L}])", " — "), (rf"(?<=[{_L}])—(?=[{_L}])", " — "), (rf"(?U)(?<=[{_L}])—\s+(?=[{_L}])", " — "), (rf"(?U)(?<=[{_L}])\s+—(?=[{_L}])", " — "))),
    (("decimal_separator_comma",), ((r"(?iU)\b(\d+(?:[,.]\d+)?)\.(\d+)(?=\s*(?:см|мм|м|км|г|кг|мг|л|мл|с|мин|ч|Вт|кВт|Па|кПа|МПа|%))", "$1,$2"),)),
    (("temperature_nbsp",), ((r"(?U)\b(\d+(?:[,.]\d+)?)°([CFС])\b", f"$1{_N}°$2"), (r"(?U)\b(\d+(?:[,.]\d+)?) °(?![CFС])", "$1°"))),
    (("percent_nbsp",), ((r"(?U)\b(\d+(?:[,.]\d+)?) ([%‰])", f"$1{_N}$2"),)),
    (("unit_nbsp", "nbsp_between_number_and_unit"), ((rf"(?iU)\b(\d+(?:[,.]\d+)?) ({_UNIT})\b", f"$1{_N}$2"),)),
    (("russian_quotes",), ((r'"([^"\n]+)"', "«$1»"),)),
    (("citation_omission_format",), ((r"(?U)\[\s*(?:\.{3}|…)\s*\]", "<...>"),)),
    (("phone_number_format",), ((r"(?U)(?<!\d)\+?7\s?\(?(\d{3})\)?[\s-]?(\d{3})[\s-]?(\d{2})[\s-]?(\d{2})(?!\d)", "+7 $1 $2-$3-$4"), (r"(?U)(?<!\d)8\s?\(?(\d{3})\)?[\s-]?(\d{3})[\s-]?(\d{2})[\s-]?(\d{2})(?!\d)", "8 $1 $2-$3-$4"), (r"(?U)(?<![\d+]|\+7 |8 )\(?(\d{3})\)?[\s-]?(\d{3})[\s-]?(\d{2})[\s-]?(\d{2})(?!\d)", "$1 $2-$3-$4"))),
)


def profile_parameters(rules: DataFrame) -> DataFrame:
    """(profile_id, params): the enabled parameters and ids of each profile; what the gates ask."""
    return rules.where(F.coalesce("enabled", F.lit(True))).groupBy("profile_id").agg(F.array_union(F.collect_set("parameter"), F.collect_set("rule_id")).alias("params"))


def safe_text(text: Column, parameters: Iterable[str]) -> Column:
    """A run's text after all rewrites that the given parameters ask for."""
    asked = set(parameters)
    for gate, steps in REWRITES:
        if asked & set(gate):
            for pattern, new in steps:
                text = F.regexp_replace(text, pattern, new)
    return text


def corrected_lines(paragraphs: DataFrame, parameters: Iterable[str]) -> DataFrame:
    """(doc_id, para_ix, old_value, new_value) of texts that the rewrites change; list hyphens first, edges last."""
    asked = set(parameters)
    text = F.col("text")
    new = F.when(text.startswith("- "), F.concat(F.lit("— "), F.substring(text, 3, 2_000_000_000))).otherwise(text) if asked & {"hyphen_list_marker_not_recommended", "list_marker_dash_required"} else text
    new = safe_text(new, asked)
    new = F.regexp_replace(new, "^ +| +$", "") if "paragraph_edge_spaces" in asked else new
    # an explosion of one, as Spark would else rewrite a text once to compare it and once more to return it
    return paragraphs.select("doc_id", "para_ix", text.alias("old_value"), F.explode_outer(F.array(new)).alias("new_value")).where("old_value <> new_value")


def corrected_runs(paragraphs: DataFrame, parameters: Iterable[str]) -> DataFrame:
    """Paragraphs with every run's text rewritten."""
    asked = set(parameters)
    return paragraphs.withColumn("runs", F.transform("runs", lambda r: r.withField("text", safe_text(r["text"], asked))))


def without_terminal_dot(text: Column | str) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)(?<!\.)\.\s*$", "")


def clamped(actual: Column, low: Column, high: Column) -> Column:
    """Inside the limits; a missing value becomes a limit."""
    return F.coalesce(F.greatest(F.least(actual, F.coalesce(high, actual)), F.coalesce(low, actual)), low, high)


def plan(rows: DataFrame, old: Column, new: Column, *keys: str) -> DataFrame:
    return rows.select("doc_id", *keys, "parameter", old.cast("string").alias("old_value"), new.cast("string").alias("new_value")).where("new_value is not null and not (old_value <=> new_value)")


def main_text_plan(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, para_ix, profile_id, parameter, old_value, new_value): exact value of a rule, else inside its limits, else the consistent value."""
    own = F.coalesce("value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string")).isNotNull()
    asked = rules.where("target = 'main_text'").select("profile_id", "parameter", (own & F.col("operator").isin("equals", "min", "max")).alias("fixed")).distinct().collect()  # a profile's rules are few
    fixed = {(r.profile_id, r.parameter) for r in asked if r.fixed}
    free = tuple(p for p in D.CONSISTENT if any(r.parameter == p and (r.profile_id, p) not in fixed for r in asked))  # only these can take the consistent value
    values = long_values(paragraphs.where("paragraph_type = 'main_text'"), only={r.parameter for r in asked})
    wanted = rules.where("target = 'main_text'").groupBy("profile_id", "parameter").agg(*(F.min_by("value_num", F.when(F.col("operator") == o, F.col("ordinal"))).alias(o) for o in ("equals", "min", "max")), F.min_by("value_str", F.when(F.col("operator") == "equals", F.col("ordinal"))).alias("text"), F.min_by("value_bool", F.when(F.col("operator") == "equals", F.col("ordinal"))).alias("yes"))
    rows = values.join(F.broadcast(wanted), "parameter")
    if free:
        chosen = D.chosen_values(paragraphs, rules, parameters=free).select("doc_id", "profile_id", "parameter", "chosen")
        rows = rows.join(chosen, ["doc_id", "profile_id", "parameter"], "left")
    else:
        rows = rows.withColumn("chosen", F.lit(None).cast("string"))
    old = F.coalesce("txt", C.number_text("num"), F.col("flag").cast("string"))
    limit = F.when(F.col("min").isNotNull() | F.col("max").isNotNull(), C.number_text(clamped(F.col("num"), F.col("min"), F.col("max"))))
    return plan(rows, old, F.coalesce(F.col("text"), C.number_text("equals"), F.col("yes").cast("string"), limit, "chosen"), "para_ix", "profile_id")


def heading_targets() -> Column:
    """Targets whose rules a heading takes, the most special first."""
    level = F.col("heading_level")
    role = F.when(F.col("is_structural_heading"), "structural_heading").when(F.col("logical_section") == "appendix", "appendix_heading").when(level == 1, "section_heading").when(level == 2, "subsection_heading").when(level == 3, "point_heading")
    return F.filter(F.array(role, F.concat(F.lit("heading_level_"), level), F.lit("heading")), lambda t: t.isNotNull())


def heading_plan(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Values of the most special heading rule; sizes of the hierarchy where none is given; numbers with commas get dots, titles lose their final dot."""
    heads = paragraphs.where("paragraph_type = 'heading'").withColumn("_targets", heading_targets())
    values = long_values(heads, ("_targets", "heading_level")).select("*", F.posexplode("_targets").alias("_rank", "target"))
    wanted = rules.where("operator = 'equals'").groupBy("profile_id", "target", "parameter").agg(F.min_by("value_num", "ordinal").alias("n"), F.min_by("value_str", "ordinal").alias("t"), F.min_by("value_bool", "ordinal").alias("b"))
    rows = values.join(F.broadcast(wanted), ["target", "parameter"])
    first = rows.groupBy("doc_id", "para_ix", "profile_id", "parameter").agg(F.min_by(F.struct("num", "txt", "flag", "n", "t", "b"), "_rank").alias("v")).select("*", "v.*")
    out = plan(first, F.coalesce("txt", C.number_text("num"), F.col("flag").cast("string")), F.coalesce("t", C.number_text("n"), F.col("b").cast("string")), "para_ix", "profile_id")
    limits = {o: rules.where(f"target = 'main_text' and parameter = 'font_size' and operator = '{o}'").orderBy("ordinal").select("value_num").first() for o in ("min", "max")}  # a profile's rules are few
    sized = heads.join(heading_sizes(paragraphs, *(F.lit(limits[o][0] if limits[o] else None).cast("double") for o in ("min", "max"))), ["doc_id", "heading_level"]).withColumn("parameter", F.lit("heading_font_size_hierarchy"))
    profiles = rules.where("parameter = 'heading_font_size_hierarchy'").select("profile_id", "parameter").distinct()
    out = out.unionByName(plan(sized.join(F.broadcast(profiles), "parameter"), C.number_text("font_size_pt"), C.number_text("expected_size"), "para_ix", "profile_id"))
    text = F.regexp_replace(F.col("text"), r"(?U)^(\d+),(\d+)", "$1.$2")
    dots = heads.withColumn("parameter", F.lit("terminal_dot")).join(F.broadcast(rules.where("parameter = 'terminal_dot'").select("profile_id", "parameter").distinct()), "parameter")
    return out.unionByName(plan(dots, F.col("text"), without_terminal_dot(text), "para_ix", "profile_id"))


def list_plan(paragraphs: DataFrame, dash: bool = True, consistent: bool = True) -> DataFrame:
    """(doc_id, para_ix, parameter, old_value, new_value): list items with the marker of their list, case and end by the text before the list."""
    groups = list_groups(paragraphs)
    modal = C.dominant(groups, ["doc_id", "list_ix"], "list_marker_type", "para_ix", "modal").select("doc_id", "list_ix", "modal")
    rows = groups.join(modal, ["doc_id", "list_ix"], "left").withColumn("parameter", F.lit("list_text"))
    body = C.stripped(F.regexp_replace(C.stripped("text"), fixed.LIST_MARKER_START, ""))
    numbered = F.coalesce(F.col("modal").isin(*fixed.NUMBERED_MARKERS), F.lit(False))
    marker = F.when(numbered & F.lit(consistent), F.when(F.col("modal") == "number_dot", F.concat("place", F.lit("."))).when(F.col("modal") == "number_bracket", F.concat("place", F.lit(")"))).otherwise(F.col("list_marker"))).otherwise(F.lit("—") if dash else F.col("list_marker"))
    colon = C.stripped(F.coalesce("before", F.lit(""))).endswith(":") & ~numbered
    cased = F.when(colon, F.concat(F.lower(F.left(body, F.lit(1))), F.substring(body, 2, 2_000_000_000))).when(numbered & F.col("modal").endswith("_dot"), F.concat(F.upper(F.left(body, F.lit(1))), F.substring(body, 2, 2_000_000_000))).otherwise(body)
    ended = F.when(colon, F.concat(F.regexp_replace(cased, r"[;.,]+$", ""), F.when(F.col("place") == F.col("list_size"), ".").otherwise(";"))).otherwise(cased)
    return plan(rows.where(body != ""), F.col("text"), F.concat_ws(" ", marker, ended), "para_ix")


INDENTS = ("first_line_indent", "left_indent", "right_indent")


def list_indent_plan(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, para_ix, profile_id, parameter, old_value, new_value): indents of list items.

    Anything with text counts as an item that is one by type, by marker or by automatic numbering, but for title pages and cells.
    Where a profile has the rule that lists stand like main text, items get its exact indents, else those that most items of
    their list have (and 1.25 for a first line without any); where it only asks for equal markers, those of most items.
    """
    exact = [F.min_by("value_num", F.when((F.col("target") == "main_text") & (F.col("operator") == "equals") & (F.col("parameter") == p) & F.col("value_num").isNotNull(), F.col("ordinal"))).alias(p) for p in INDENTS]
    main, same = F.bool_or(F.col("rule_id") == "list_indent_equals_main_text"), F.bool_or(F.col("parameter") == "list_marker_consistency")
    asked = rules.groupBy("profile_id").agg(main.alias("main"), same.alias("same"), *exact).where("main or same").orderBy("profile_id").collect()  # one row a profile
    profile = lambda r: F.struct(F.lit(r["profile_id"]).alias("profile_id"), F.lit(bool(r["main"])).alias("main"), *(F.lit(r[p]).cast("double").alias(p) for p in INDENTS))
    profiles = F.array(*map(profile, asked)).cast(f"array<struct<profile_id:string,main:boolean,{','.join(f'{p}:double' for p in INDENTS)}>>")
    kind = F.coalesce("paragraph_type", F.lit(""))
    item = C.not_blank("text") & ~kind.isin("title_page", "table_cell") & ((kind == "list_item") | F.coalesce("is_automatic_list", F.lit(False)) | F.col("list_marker_type").isNotNull())
    own = lambda p: F.bround(F.coalesce(F.col(f"{p}_cm").cast("double"), F.lit(0.0)), 2)
    groups = list_groups(paragraphs, item).withColumn("_own", F.struct(*(own(p).alias(p) for p in INDENTS)))
    most = C.dominant(groups, ["doc_id", "list_ix"], "_own", "para_ix", "most").select("doc_id", "list_ix", "most")
    rows = groups.join(most, ["doc_id", "list_ix"]).withColumn("_p", F.explode(profiles)).withColumn("profile_id", F.col("_p.profile_id"))
    usual = lambda p: F.when(F.col("_p.main") & (F.col(f"most.{p}") == 0), 1.25).otherwise(F.col(f"most.{p}")) if p == "first_line_indent" else F.col(f"most.{p}")
    wanted = lambda p: F.coalesce(F.when(F.col("_p.main"), F.col(f"_p.{p}")), usual(p))
    changes = F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(f"_own.{p}").alias("old"), wanted(p).alias("new")) for p in INDENTS))
    each = rows.select("doc_id", "para_ix", "profile_id", F.explode(changes).alias("c")).select("*", "c.parameter")
    return plan(each, C.number_text(F.col("c.old")), C.number_text(F.col("c.new")), "para_ix", "profile_id")


def caption_plan(paragraphs: DataFrame, prefixes: dict[str, str], separator: str = " — ", terminal_dot: bool = False) -> DataFrame:
    """Captions as prefix, number, separator, title. Table captions stay with what follows, and so does the picture of a figure caption, within five rows above."""
    rows = paragraphs.where("paragraph_type = 'caption'").withColumn("parameter", F.lit("caption_text"))
    prefix = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv)), F.col("caption_kind")), F.col("caption_prefix"))
    title = F.regexp_replace(F.regexp_replace("caption_title", r"(?U)^[\s—–.-]+", ""), r"\.+\s*$", "")
    new = F.concat(prefix, F.lit(" "), F.col("caption_number"), F.when(title != "", F.concat(F.lit(separator), title)).otherwise(""), F.lit("." if terminal_dot else ""))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_ix"))
    meaningful = paragraphs.where((C.not_blank("text") | F.coalesce("has_inline_image", F.lit(False))) & ~F.coalesce("paragraph_type", F.lit("")).isin("table_cell", "title_page")).withColumn("_k", rank)
    last = F.last(F.when(F.col("has_inline_image"), F.struct("_k", F.col("para_ix").alias("at"))), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("para_ix"))
    pictures = meaningful.withColumn("_image", last).where("caption_kind = 'figure' and _k - _image._k <= 5").select("doc_id", F.col("_image.at").alias("para_ix")).distinct()
    keeps = paragraphs.where("paragraph_type = 'caption' and caption_kind = 'table'").unionByName(paragraphs.join(pictures, ["doc_id", "para_ix"], "left_semi").select(paragraphs.columns)).withColumn("parameter", F.lit("keep_with_next"))
    return plan(rows, F.col("text"), new, "para_ix").unionByName(plan(keeps, F.coalesce("keep_with_next", F.lit(False)), F.lit(True), "para_ix"))


def margin_plan(sections: DataFrame, rules: DataFrame, exact: tuple[float, ...] | None = None) -> DataFrame:
    """(doc_id, section_ix, profile_id, parameter, old_value, new_value): the exact pattern if given, else each document's target, for which equals rules are not asked."""
    if exact is not None:
        target = F.struct(*(F.lit(v).alias(m) for m, v in zip(D.MARGINS, exact)))
        profiles = [F.lit(r[0]) for r in rules.select("profile_id").distinct().collect()]  # the profiles asked for
        rows = sections.withColumn("target", target).withColumn("profile_id", F.explode(F.array(*profiles)))
    else:
        rows = sections.join(D.margin_targets(sections, rules, operators=("min", "max")), "doc_id")
    each = rows.select("doc_id", "section_ix", "profile_id", F.explode(F.array(*(F.struct(F.lit(m).alias("parameter"), F.bround(f"{m}_cm", 2).alias("old"), F.col(f"target.{m}").alias("new")) for m in D.MARGINS))).alias("m")).select("doc_id", "section_ix", "profile_id", "m.*")
    return plan(each, C.number_text("old"), C.number_text("new"), "section_ix", "profile_id")


def _asked(rules: DataFrame) -> dict[str, float | None]:
    """Enabled parameters of a profile, whose rules are few, with the number of the first rule of each."""
    out: dict[str, float | None] = {}
    for r in rules.where(F.coalesce("enabled", F.lit(True))).orderBy("ordinal").select("parameter", "value_num").collect():
        out.setdefault(r.parameter, r.value_num)
    return out


def page_plan(sections: DataFrame, rules: DataFrame, least: float = 1.25) -> DataFrame:
    """What the rules ask for: header and footer distances of at least their value, a number in the footer, none on the first page."""
    entry = lambda p, old, new: F.struct(F.lit(p).alias("parameter"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    asked = _asked(rules)
    facts = [entry(p, C.number_text(f"{p}_cm"), C.number_text(F.greatest(F.coalesce(f"{p}_cm", F.lit(0.0)), F.lit(asked[p] if asked[p] is not None else least)))) for p in ("header_distance", "footer_distance") if p in asked]
    if "page_number_area" in asked:
        facts.append(entry("page_number_area", F.col("page_number_area"), F.lit("footer")))
    if "first_page_no_page_number" in asked:
        shown = F.coalesce("first_page_has_page_number", F.lit(False))
        facts.append(entry("first_page_number", shown, shown & (F.col("section_ix") != 0)))
    kind = "array<struct<parameter:string,old:string,new:string>>"
    each = sections.select("doc_id", "section_ix", F.explode(F.array(*facts).cast(kind)).alias("f")).select("doc_id", "section_ix", "f.*")
    return plan(each, F.col("old"), F.col("new"), "section_ix")


def table_plan(paragraphs: DataFrame, tables: DataFrame, rules: DataFrame) -> DataFrame:
    """What the rules ask of cells (size, single spacing, no indents, left but for header rows) and of long tables (repeated header, rows that break)."""
    cells = paragraphs.where("paragraph_type = 'table_cell'")
    entry = lambda p, old, new: F.struct(F.lit(p).alias("parameter"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    asked, facts = _asked(rules), []
    if asked.keys() & {"table_text_spacing_indent", "table_text_line_spacing"}:
        facts.append(entry("line_spacing", C.number_text("line_spacing"), F.lit("1")))
    if "table_text_spacing_indent" in asked:
        facts += [entry(c, C.number_text(f"{c}_cm"), F.lit("0")) for c in ("first_line_indent", "left_indent", "right_indent")]
        facts.append(entry("alignment", F.col("alignment"), F.when(F.col("table_row_ix") == 0, F.col("alignment")).otherwise("left")))
    size = next((asked[p] for p in ("table_text_font_size", "table_font_size") if asked.get(p) is not None), None)
    if size is not None:
        facts.append(entry("font_size", C.number_text("font_size_pt"), C.number_text(F.lit(size))))
    kind = "array<struct<parameter:string,old:string,new:string>>"
    each = cells.select("doc_id", "table_ix", "para_ix", F.explode(F.array(*facts).cast(kind)).alias("f")).select("doc_id", "table_ix", "para_ix", "f.*")
    wide = []
    if "table_repeat_header" in asked:
        wide.append(entry("repeats_header", F.coalesce("repeats_header", F.lit(False)), F.lit(True)))
    if "table_allow_row_break" in asked:
        wide.append(entry("cant_split_rows", F.coalesce("has_cant_split_rows", F.lit(False)), F.lit(False)))
    whole = tables.where("rows_count > 8").select("doc_id", "table_ix", F.lit(None).cast("int").alias("para_ix"), F.explode(F.array(*wide).cast(kind)).alias("f")).select("doc_id", "table_ix", "para_ix", "f.*")
    return plan(each.unionByName(whole), F.col("old"), F.col("new"), "table_ix", "para_ix")


def protected(paragraphs: DataFrame, leading: DataFrame) -> DataFrame:
    """(doc_id, para_ix) that corrections leave alone: contents lines and the leading list of headings."""
    toc = paragraphs.where("logical_section = 'toc'").select("doc_id", "para_ix")
    return toc.unionByName(leading.select("doc_id", "para_ix")).distinct()


def unprotected(plan_rows: DataFrame, rows: DataFrame) -> DataFrame:
    return plan_rows.join(rows, ["doc_id", "para_ix"], "left_anti")


def without_empty(paragraphs: DataFrame) -> DataFrame:
    """Without blank rows between the first and the last row with text."""
    bounds = paragraphs.groupBy("doc_id").agg(F.min(F.when(C.not_blank("text"), F.col("para_ix"))).alias("_lo"), F.max(F.when(C.not_blank("text"), F.col("para_ix"))).alias("_hi"))
    inside = ~C.not_blank("text") & (F.col("para_ix") > F.col("_lo")) & (F.col("para_ix") < F.col("_hi"))
    return paragraphs.join(bounds, "doc_id").where(~F.coalesce(inside, F.lit(False))).drop("_lo", "_hi")


def dominant_allowed(paragraphs: DataFrame, rules: DataFrame, parameters: tuple[str, ...] = D.CONSISTENT) -> DataFrame:
    """(doc_id, profile_id, parameter, value): the most frequent allowed value; without an allowed one the most frequent, unless others tie."""
    counts = D.value_counts(paragraphs, parameters)
    pairs = rules.select("profile_id", F.explode(F.array(*map(F.lit, parameters))).alias("parameter")).distinct()
    judged = D.allowed_values(counts.join(F.broadcast(pairs), "parameter"), rules)
    best, last = F.struct((-F.col("n")).alias("n"), "first_ix", "value"), F.struct("n", "first_ix", "value")
    rows = judged.groupBy("doc_id", "profile_id", "parameter").agg(F.min_by("value", F.when(F.col("allowed"), best)).alias("a"), F.min_by("value", best).alias("top"), F.max_by("value", last).alias("other"))
    tie = F.col("top") != F.col("other")  # the first and the last of the most frequent values
    return rows.select("doc_id", "profile_id", "parameter", F.coalesce("a", F.when(~tie, F.col("top"))).alias("value"))
