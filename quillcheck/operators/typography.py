"""Typography checks of paragraphs, runs, lists and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.functions import fixed
from quillcheck.functions.running import running
from quillcheck.operators import prefilter
from quillcheck.operators.violations import findings

_RULE = ("profile_id", "rule_id", "source_section", "target", "parameter", "modality", "category")


def in_scope() -> Column:
    """Paragraphs that are checked: with text, no title page, no bibliography, no code."""
    style, text = F.lower(F.coalesce(F.col("style_name"), F.lit(""))), F.coalesce("text", F.lit(""))
    bibliography = style.rlike("bibliography|литератур") | (F.contains(text, F.lit("[")) & text.rlike(r"(?U)^\s*\[\d+\]\s+"))
    code = style.rlike("code|код") | text.rlike(r"(?U)^\s*(def |class |import |from |if \(|for \()")
    return (text != "") & (F.coalesce("paragraph_type", F.lit("")) != "title_page") & ~bibliography & ~code


def ignored_value(fragment: Column, text: Column) -> Column:
    """Fragments that are no value: in a text with an address or a standard's number; a version of three parts or more; a four-digit number."""
    held = lambda t, *parts: reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in parts))  # noqa: E731  what a match holds, looked for first
    url = held(F.lower(text), "://", "www.") & text.rlike(fixed.URL)
    return url | (held(text, "@") & text.rlike(fixed.EMAIL)) | (held(F.upper(text), "ГОСТ") & text.rlike(fixed.STANDARD_NUMBER)) | fragment.rlike(r"^\d+(?:\.\d+){2,3}$") | fragment.rlike(r"^\d{4}$")


def last_rules(rules: DataFrame, parameters: list[str]) -> DataFrame:
    """One rule for each profile and parameter: the last that is enabled and has it as parameter, or as id."""
    key = F.when(F.col("parameter").isin(parameters), F.col("parameter")).when(F.col("rule_id").isin(parameters), F.col("rule_id"))
    keyed = rules.where(F.coalesce("enabled", F.lit(True))).withColumn("_key", key).where("_key is not null")
    last = F.row_number().over(Window.partitionBy("profile_id", "_key").orderBy(F.desc("ordinal")))
    return keyed.withColumn("_last", last).where("_last = 1").withColumn("parameter", F.col("_key")).drop("_key", "_last")


def _square_brackets(text: Column) -> Column:
    return F.get(F.filter(C.all_matches(text, fixed.SQUARE_BRACKETS), lambda x: ~x.rlike(fixed.REFERENCE_BRACKETS)), F.lit(0))


def _phone(text: Column) -> Column:
    """The first telephone number that is not written as it should be."""
    found = F.transform(C.all_matches(text, fixed.PHONE), C.stripped)
    return F.get(F.filter(found, lambda x: ~x.rlike(fixed.VALID_PHONE)), F.lit(0))


def text_hits(any_language: bool = False, only: set[str] | None = None) -> Column | None:
    """Array of (parameter, fragment, level): every pattern (of all parameters, or those of only) that a paragraph's text breaks, one entry a pattern and parameter; None where only names no pattern.

    Needs the bits of prefilter.with_possible beside the paragraph's columns; a pattern that several parameters share is asked once.
    """
    text = F.col("text")
    rule = lambda parameter, level: F.struct(F.lit(parameter).alias("parameter"), F.lit(level).alias("level"), F.lit(parameter in fixed.VALUE_PARAMETERS).alias("value"))
    hit = lambda rules, fragment, when: F.when(when, F.struct(F.array(*rules).alias("rules"), fragment.alias("fragment")))
    asked: dict[tuple[str, ...], tuple[list[Column], Column]] = {}  # by the patterns of an entry: its rules, and whether any can match
    places: dict[str, int] = {}
    for parameter, pattern, level in fixed.TYPOGRAPHY:
        place = places[parameter] = places.get(parameter, -1) + 1
        if only is not None and parameter not in only:
            continue
        can = prefilter.possible(parameter, place)
        if parameter == "spaces_inside_brackets_quotes":  # the closing side is asked only if the opening side is right
            patterns = tuple(p for q, p, _ in fixed.TYPOGRAPHY if q == parameter)
            rules, either = asked.get(patterns, ([rule(parameter, level)], F.lit(False)))
            asked[patterns] = rules, either | can
        else:
            rules, _ = asked.setdefault((pattern,), ([], can))
            rules.append(rule(parameter, level))
    hits = [hit(rules, F.coalesce(*(C.first_match(text, p) for p in patterns)), can) for patterns, (rules, can) in asked.items()]
    one = lambda parameter, level, fragment, when: only is not None and parameter not in only or hits.append(hit([rule(parameter, level)], fragment, when))
    one("paragraph_edge_spaces", "error", F.lit("space at the edge"), text.rlike("^ | $"))
    cyrillic = F.lit(True) if any_language else text.rlike("[А-Яа-яЁё]")
    one("russian_quotes", "warning", C.first_match(text, fixed.STRAIGHT_QUOTES), prefilter.possible("russian_quotes") & cyrillic)
    one("square_brackets_usage", "warning", _square_brackets(text), prefilter.possible("square_brackets_usage"))
    one("phone_number_format", "error", _phone(text), prefilter.possible("phone_number_format"))
    label = F.coalesce(F.col("caption_kind") == "table", F.lit(False)) | (F.lower(text).rlike("удк|ключевые слова") & F.lower(C.stripped(text)).rlike(r"^(удк|ключевые слова)"))
    one("no_dot_after_udc_keywords_table_title", "error", F.when(C.stripped(text).endswith("."), F.lit(".")), label)
    note = F.coalesce(F.col("paragraph_type").isin("note", "footnote"), F.lit(False))
    one("dot_after_footnote_or_note", "error", F.when(~C.stripped(text).rlike(r"[.!?…]$"), F.lit("no end sign")), note)
    if not hits:
        return None
    found = F.filter(F.array(*hits), lambda h: h.isNotNull() & h["fragment"].isNotNull())
    counted = lambda h: F.filter(h["rules"], lambda r: ~(r["value"] & F.coalesce(ignored_value(h["fragment"], text), F.lit(False))))  # noqa: E731  an address or a version is no value
    return F.flatten(F.transform(found, lambda h: F.transform(counted(h), lambda r: F.struct(r["parameter"].alias("parameter"), h["fragment"].alias("fragment"), r["level"].alias("level")))))


def equation_hits() -> Column:
    text, standalone = F.col("text"), F.coalesce("is_standalone_equation", F.lit(False))
    made = lambda p, when, what, level: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(p).alias("parameter"), F.lit(what).alias("fragment"), F.lit(level).alias("level")))
    return F.filter(
        F.array(
            made("equations_editable", F.col("has_formula_like_image"), "formula as an image", "warning"),
            made("long_equation_standalone", text.rlike(fixed.EQUATION_NUMBER) & ~F.coalesce("has_equation", F.lit(False)) & (F.col("paragraph_type") == "main_text"), "numbered text without an equation", "warning"),
            made("equation_alignment_left", standalone & (F.col("alignment") != "left"), "not left", "error"),
            made("equation_number_right", standalone & ~text.rlike(fixed.EQUATION_NUMBER), "no number", "error"),
            made("equation_line_break_rule", F.col("has_equation") & F.coalesce("has_line_break", F.lit(False)) & ~text.rlike(r"(?U)[=+\-−±×·/]\s*(\n|$)"), "break after no operator", "error"),
        ),
        lambda h: h.isNotNull(),
    )


def list_hits() -> Column:
    """Needs main_indent, the document's modal first-line indent of main text, beside the paragraph's columns."""
    kind, automatic = F.col("list_marker_type"), F.coalesce("is_automatic_list", F.lit(False))
    numbered = F.coalesce(kind.isin(*fixed.NUMBERED_MARKERS), F.lit(False))
    indent = F.coalesce("first_line_indent_cm", F.lit(0.0))
    shown = F.coalesce("list_marker", F.when(automatic, "automatic").otherwise("none"))
    made = lambda p, when, what, level="error": F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(p).alias("parameter"), what.alias("fragment"), F.lit(level).alias("level")))
    hits = F.filter(
        F.array(
            made("list_marker_allowed", kind.isNull() & ~automatic, F.lit("none")),
            made("list_marker_dash_required", ~numbered & ~F.coalesce(kind == "dash", F.lit(False)), shown),
            made("hyphen_list_marker_not_recommended", kind == "hyphen", F.lit("-"), "warning"),
            made("list_indent_equals_main_text", F.abs(indent - F.col("main_indent")) > 0.05, C.number_text(indent)),
            made("automatic_list_numbering_required", numbered & ~automatic, F.coalesce("list_marker", F.lit("typed"))),
        ),
        lambda h: h.isNotNull(),
    )
    return F.when(F.col("paragraph_type") == "list_item", hits).otherwise(F.slice(hits, 1, 0))


def wanted_rules(rules: DataFrame) -> DataFrame:
    """The rules that count here, one for each profile and parameter."""
    return last_rules(rules, sorted({p for p, *_ in fixed.TYPOGRAPHY} | set(OTHERS)))


def _with_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    joined = hits.join(F.broadcast(wanted_rules(rules).select(*_RULE)), "parameter")  # rules are a small table of given profiles
    return findings(joined, F.lit("as the rule says"), F.col("fragment"), F.col("level"))


OTHERS = (
    "paragraph_edge_spaces", "russian_quotes", "square_brackets_usage", "phone_number_format", "no_dot_after_udc_keywords_table_title", "dot_after_footnote_or_note", "equations_editable", "long_equation_standalone", "equation_alignment_left", "equation_number_right", "equation_line_break_rule",
    "list_marker_allowed", "list_marker_dash_required", "hyphen_list_marker_not_recommended", "list_indent_equals_main_text", "automatic_list_numbering_required", "variable_italic", "function_and_chemical_regular", "index_language_consistency", "numbered_equation_has_reference", "multiplication_sign_consistency",
    "dimension_consistency", "scientific_notation_consistency", "phone_country_code_consistency", "footnotes_processor_required", "footnotes_continuous_decimal_numbering", "footnotes_format_consistency", "footnote_font_family_and_size", "list_punctuation_policy", "list_marker_consistency", "list_indent_consistency",
)


#: Parameters of equation_hits and of list_hits.
EQUATIONS = ("equations_editable", "long_equation_standalone", "equation_alignment_left", "equation_number_right", "equation_line_break_rule")
LISTS = ("list_marker_allowed", "list_marker_dash_required", "hyphen_list_marker_not_recommended", "list_indent_equals_main_text", "automatic_list_numbering_required")


def _exploded(hits: DataFrame) -> DataFrame:
    """A row for each of hits; outer first, as Spark would else ask for the size of the array by making it twice."""
    return hits.select("doc_id", "para_ix", F.explode_outer("hits").alias("h")).where("h is not null").select("doc_id", "para_ix", "h.*")


def fragments(paragraphs: DataFrame, any_language: bool = False, filtered: bool = True, repeated: bool = False) -> DataFrame:
    """(doc_id, para_ix, parameter, fragment, level) of every broken pattern, whatever the rules; one pass over the texts.

    filtered=False asks every pattern of every line, repeated=True each different text once (for collections in which most
    texts stand many times), with the same result.
    """
    have = paragraphs
    for name, kind in (("paragraph_type", "string"), ("logical_section", "string"), ("style_name", "string"), ("caption_kind", "string")):
        if name not in have.columns:
            have = have.withColumn(name, F.lit(None).cast(kind))
    look = prefilter.with_possible if filtered else prefilter.everything
    rows = C.once(have, "text").where(in_scope())
    if not repeated:
        return _exploded(look(rows).select("doc_id", "para_ix", text_hits(any_language).alias("hits")))
    # all that the patterns look at: the text, and whether it is a table's caption or a note
    table, note = F.when(F.col("caption_kind") == "table", "table"), F.when(F.col("paragraph_type").isin("note", "footnote"), "note")
    keys = {"text": F.col("text"), "caption_kind": F.coalesce(table, F.lit("")), "paragraph_type": F.coalesce(note, F.lit(""))}
    rows = rows.select("doc_id", "para_ix", *(c.alias(n) for n, c in keys.items()))
    found = look(rows.select(*keys).distinct()).select(*keys, F.explode_outer(text_hits(any_language)).alias("h")).where("h is not null")
    return rows.join(found, [*keys]).select("doc_id", "para_ix", "h.*")


def check_paragraphs(paragraphs: DataFrame, rules: DataFrame, any_language: bool = False) -> DataFrame:
    """Findings of text, equation and list rules. paragraphs has the full schema; a main_indent is found here.

    Only what the rules ask for is looked for, the main indent too.
    """
    asked = {r.parameter for r in wanted_rules(rules).select("parameter").distinct().collect()}  # the rules of the profiles that were asked for
    rows = paragraphs.withColumn("main_indent", F.lit(None).cast("double"))
    if "list_indent_equals_main_text" in asked:
        main = C.dominant(paragraphs.where("paragraph_type = 'main_text'").withColumn("_v", F.bround("first_line_indent_cm", 2)), ["doc_id"], "_v", "para_ix", "main_indent")
        rows = paragraphs.join(main.select("doc_id", "main_indent"), "doc_id", "left")
    parts = [text_hits(any_language, asked), equation_hits() if asked & set(EQUATIONS) else None, list_hits() if asked & set(LISTS) else None]
    parts = [p for p in parts if p is not None]
    if not parts:
        rows, parts = rows.where(F.lit(False)), [equation_hits()]
    rows = prefilter.with_possible(C.once(rows, "text").where(in_scope()), asked)
    hits = _exploded(rows.select("doc_id", "para_ix", F.concat(*parts).alias("hits")))
    return _with_rules(hits, rules)


def check_runs(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Variables in roman, functions and formulas in italics, indices of mixed alphabets; the first of each in a paragraph."""
    runs = paragraphs.where(in_scope()).select("doc_id", "para_ix", F.explode("runs").alias("r")).select("doc_id", "para_ix", "r.*").where(C.not_blank("text"))
    italic = F.coalesce("italic", F.lit(False))
    mixed = F.col("text").rlike("[A-Za-z]") & F.col("text").rlike("[А-Яа-яЁё]")
    made = lambda p, fragment, level: F.when(fragment.isNotNull(), F.struct(F.lit(p).alias("parameter"), fragment.alias("fragment"), F.lit(level).alias("level")))
    hits = F.array(
        made("variable_italic", F.when(~italic, C.first_match("text", fixed.VARIABLE)), "warning"),
        made("function_and_chemical_regular", F.when(italic, F.coalesce(C.first_match("text", fixed.FUNCTION), C.first_match("text", fixed.CHEMICAL))), "warning"),
        made("index_language_consistency", F.when(F.coalesce("subscript", F.lit(False)) & mixed, F.col("text")), "warning"),
        made("index_language_consistency", F.when(F.coalesce("subscript", F.lit(False)) & C.stripped("text").endswith("."), F.col("text")), "error"),
    )
    rows = runs.select("doc_id", "para_ix", "run_ix", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("doc_id", "para_ix", "run_ix", "h.*")
    once = rows.where("parameter <> 'index_language_consistency'").groupBy("doc_id", "para_ix", "parameter", "level").agg(F.min_by("fragment", "run_ix").alias("fragment"))
    every = rows.where("parameter = 'index_language_consistency'").select("doc_id", "para_ix", "parameter", "level", "fragment")
    return _with_rules(once.unionByName(every), rules)


def equation_reference_gaps(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, parameter, fragment, level): equation numbers that no text refers to, and references without equation."""
    numbers = paragraphs.where("has_equation").select("doc_id", C.first_match("text", fixed.EQUATION_NUMBER, 1).alias("number")).where("number is not null").distinct()
    referred = paragraphs.select("doc_id", F.explode(C.all_matches("text", fixed.EQUATION_REFERENCE, 1)).alias("number")).distinct()
    unused, missing = numbers.join(referred, ["doc_id", "number"], "left_anti"), referred.join(numbers, ["doc_id", "number"], "left_anti")
    made = lambda df, level: df.select("doc_id", F.lit("numbered_equation_has_reference").alias("parameter"), F.col("number").alias("fragment"), F.lit(level).alias("level"))
    return made(unused, "warning").unionByName(made(missing, "error"))


def notation_mixes(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, parameter, fragment, level): documents that write the same thing in different ways."""
    text = F.col("text")
    country = lambda p: F.when(p.rlike(r"^\s*\+7"), "+7").when(p.rlike(r"^\s*8"), "8").otherwise("none")
    marks = F.concat(
        F.when(F.contains("text", F.lit("×")), F.array(F.struct(F.lit("multiplication_sign_consistency").alias("parameter"), F.lit("").alias("key"), F.lit("×").alias("way")))).otherwise(F.array().cast("array<struct<parameter:string,key:string,way:string>>")),
        F.when(F.contains("text", F.lit("·")), F.array(F.struct(F.lit("multiplication_sign_consistency").alias("parameter"), F.lit("").alias("key"), F.lit("·").alias("way")))).otherwise(F.array().cast("array<struct<parameter:string,key:string,way:string>>")),
        F.transform(C.all_matches(text, fixed.SCIENTIFIC_TEN), lambda x: F.struct(F.lit("scientific_notation_consistency").alias("parameter"), F.lit("").alias("key"), F.lit("power of ten").alias("way"))),
        F.transform(C.all_matches(text, fixed.SCIENTIFIC_E), lambda x: F.struct(F.lit("scientific_notation_consistency").alias("parameter"), F.lit("").alias("key"), F.lit("exponent").alias("way"))),
        F.transform(C.all_matches(text, fixed.PHONE), lambda x: F.struct(F.lit("phone_country_code_consistency").alias("parameter"), F.lit("").alias("key"), country(x).alias("way"))),
        F.transform(C.all_matches(text, r"(?U)\b[А-Яа-яA-Za-z]+(?:/|·)[А-Яа-яA-Za-z]+\b"), lambda x: F.struct(F.lit("dimension_consistency").alias("parameter"), F.lower(F.regexp_replace(x, "[/·]", " ")).alias("key"), x.alias("way"))),
    )
    ways = paragraphs.where(C.not_blank("text")).select("doc_id", F.explode(marks).alias("m")).select("doc_id", "m.*").groupBy("doc_id", "parameter", "key").agg(F.array_sort(F.collect_set("way")).alias("ways")).where(F.size("ways") > 1)
    first = F.row_number().over(Window.partitionBy("doc_id", "parameter").orderBy("key"))
    level = F.when(F.col("parameter").isin("multiplication_sign_consistency", "dimension_consistency"), "warning").otherwise("error")
    return ways.withColumn("_n", first).where("_n <= 3").select("doc_id", "parameter", F.array_join("ways", ", ").alias("fragment"), level.alias("level"))


def footnote_findings(paragraphs: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """(doc_id, para_ix, parameter, fragment, level) of the four footnote rules."""
    none = F.lit(None).cast("int").alias("para_ix")
    manual = paragraphs.where(F.col("text").rlike(r"(?U)\w(?:\*+|[¹²³])(?:\s|$)")).select("doc_id").distinct()
    without = doc_meta.where(~F.coalesce("has_footnotes_part", F.lit(False))).join(manual, "doc_id", "left_semi").select("doc_id", none, F.lit("footnotes_processor_required").alias("parameter"), F.lit("marks typed by hand").alias("fragment"), F.lit("error").alias("level"))
    numbering = doc_meta.where(F.coalesce("has_footnotes_part", F.lit(False)) & ((F.coalesce("footnote_number_format", F.lit("decimal")) != "decimal") | (F.coalesce("footnote_number_restart", F.lit("continuous")) != "continuous")))
    numbering = numbering.select("doc_id", none, F.lit("footnotes_continuous_decimal_numbering").alias("parameter"), F.concat_ws(", ", "footnote_number_format", "footnote_number_restart").alias("fragment"), F.lit("error").alias("level"))
    notes = paragraphs.where("paragraph_type = 'footnote'")
    long = notes.select("doc_id", "para_ix", F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in ("font_family", "font_size_pt", "alignment", "line_spacing", "first_line_indent_cm")))).alias("a")).select("doc_id", "para_ix", "a.*").where("value is not null")
    modal = C.dominant(long, ["doc_id", "attribute"], "value", "para_ix", "modal")
    mixed = long.join(modal, ["doc_id", "attribute"]).where("value <> modal").select("doc_id", "para_ix", F.lit("footnotes_format_consistency").alias("parameter"), F.concat_ws(": ", "attribute", "value").alias("fragment"), F.lit("error").alias("level"))
    main = paragraphs.where("paragraph_type = 'main_text'")
    family, size = C.dominant(main, ["doc_id"], "font_family", "para_ix", "main_family"), C.dominant(main, ["doc_id"], "font_size_pt", "para_ix", "main_size")
    small = paragraphs.where("paragraph_type in ('footnote', 'note')").join(family.select("doc_id", "main_family"), "doc_id").join(size.select("doc_id", "main_size"), "doc_id")
    off = (F.col("font_family") != F.col("main_family")) | (F.abs(F.col("font_size_pt") - (F.col("main_size") - 2)) > 0.5)
    small = small.where(off).select("doc_id", "para_ix", F.lit("footnote_font_family_and_size").alias("parameter"), F.concat_ws(", ", "font_family", C.number_text("font_size_pt")).alias("fragment"), F.lit("error").alias("level"))
    return without.unionByName(numbering).unionByName(mixed).unionByName(small)


def list_groups(paragraphs: DataFrame, item: Column | None = None) -> DataFrame:
    """List items with list_ix, the number of their unbroken list in the document, place and size in it, and before, the text above it.

    item: what counts as one, if not rows of that type with text.
    """
    item = (F.col("paragraph_type") == "list_item") & C.not_blank("text") if item is None else item
    content = C.not_blank("text") & ~F.coalesce("paragraph_type", F.lit("")).isin("empty", "title_page", "table_cell")
    marked = paragraphs.withColumn("_item", F.coalesce(item, F.lit(False)))
    marked = running(marked, ["doc_id"], "para_ix", before=True, sums={"list_ix": F.when(F.col("_item"), 0).otherwise(1)}, lasts={"_before": F.when(content, F.col("text"))})  # an item's list is numbered by the other rows before it
    in_list = Window.partitionBy("doc_id", "list_ix").orderBy("para_ix")
    rows = marked.where("_item").withColumn("place", F.row_number().over(in_list)).withColumn("list_size", F.count("*").over(Window.partitionBy("doc_id", "list_ix")))
    return rows.withColumn("before", F.first("_before").over(in_list)).drop("_item", "_before")


def list_consistency(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_ix, parameter, fragment, level): punctuation, markers and indents that differ from the rest of a list."""
    groups = list_groups(paragraphs)
    body = C.stripped(F.regexp_replace(C.stripped("text"), fixed.LIST_MARKER_START, ""))
    first, last = C.first_match(body, "[A-Za-zА-Яа-яЁё]"), F.col("place") == F.col("list_size")
    colon = C.stripped(F.coalesce("before", F.lit(""))).endswith(":")
    bullets = F.coalesce(F.col("list_marker_type").isin("dash", "hyphen", "bullet"), F.lit(False))
    starts_upper = F.col("list_marker_type").isin("number_dot", "letter_dot")
    faults = F.array(
        F.when(bullets & colon & (first != F.lower(first)), "starts with a capital"),
        F.when(bullets & colon & ~last & ~body.endswith(";"), "no semicolon at the end"),
        F.when(bullets & colon & last & ~body.endswith("."), "no full stop at the end"),
        F.when(starts_upper & (first != F.upper(first)), "starts with a small letter"),
    )
    policy = groups.where(body != "").select("doc_id", "para_ix", F.lit("list_punctuation_policy").alias("parameter"), F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fragment"))
    sign = groups.withColumn("_sign", F.concat_ws(" ", F.coalesce("list_marker_type", F.lit("none")), F.when(~F.coalesce(F.col("list_marker_type").isin(*fixed.NUMBERED_MARKERS), F.lit(False)), F.col("list_marker"))))
    modal = C.dominant(sign, ["doc_id", "list_ix"], "_sign", "para_ix", "modal").select("doc_id", "list_ix", "modal")
    markers = sign.join(modal, ["doc_id", "list_ix"]).where("_sign <> modal").select("doc_id", "para_ix", F.lit("list_marker_consistency").alias("parameter"), F.col("_sign").alias("fragment"))
    indent = groups.where("list_size >= 2").withColumn("_ind", F.concat_ws("/", *(C.number_text(F.coalesce(c, F.lit(0.0))) for c in ("first_line_indent_cm", "left_indent_cm", "right_indent_cm"))))
    modal = C.dominant(indent, ["doc_id", "list_ix"], "_ind", "para_ix", "modal").select("doc_id", "list_ix", "modal")
    indents = indent.join(modal, ["doc_id", "list_ix"]).where("_ind <> modal").select("doc_id", "para_ix", F.lit("list_indent_consistency").alias("parameter"), F.col("_ind").alias("fragment"))
    return policy.unionByName(markers).unionByName(indents).withColumn("level", F.lit("error"))


def check_documents(paragraphs: DataFrame, doc_meta: DataFrame, rules: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    whole = equation_reference_gaps(paragraphs).unionByName(notation_mixes(paragraphs)).withColumn("para_ix", none)
    hits = whole.unionByName(footnote_findings(paragraphs, doc_meta)).unionByName(list_consistency(paragraphs))
    return _with_rules(hits, rules)
