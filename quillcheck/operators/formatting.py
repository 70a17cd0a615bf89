"""Checks of paragraph, heading and run formatting against rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.operators import settings as S
from quillcheck.operators.violations import findings

RULE = ("profile_id", "rule_id", "source_section", "target", "parameter", "operator", "unit", "modality", "category", "value_num", "value_str", "value_bool", "value_list")
NUMBERS = {"font_size": "font_size_pt", "first_line_indent": "first_line_indent_cm", "left_indent": "left_indent_cm", "right_indent": "right_indent_cm", "line_spacing": "line_spacing", "space_before": "space_before_pt", "space_after": "space_after_pt"}
TEXTS = {"font_family": "font_family", "alignment": "alignment"}
FLAGS = {"bold": "bold", "italic": "italic", "keep_with_next": "keep_with_next", "keep_together": "keep_together", "page_break_before": "page_break_before"}
ZERO_IF_NULL = ("first_line_indent", "left_indent", "right_indent", "space_before", "space_after")
#: target -> (paragraph types, heading level, logical section)
TARGETS = (
    ("main_text", "main_text", None, None), ("heading", "heading", None, None), ("heading_level_1", "heading", 1, None), ("heading_level_2", "heading", 2, None), ("heading_level_3", "heading", 3, None), ("section_heading", "heading", 1, "main_part"),
    ("subsection_heading", "heading", 2, None), ("point_heading", "heading", 3, None), ("structural_heading", "heading", 1, "structural"), ("appendix_heading", "heading", 1, "appendix"), ("caption", "caption", None, None), ("figure_caption", "caption", None, "figure"),
    ("table_caption", "caption", None, "table"), ("list_item", "list_item", None, None), ("footnote", "footnote", None, None), ("note", "note", None, None), ("table_cell", "table_cell", None, None), ("additional_text", "caption", None, None), ("additional_text", "footnote", None, None), ("additional_text", "table_cell", None, None),
)


def long_values(paragraphs: DataFrame, keep: tuple[str, ...] = (), only: Iterable[str] | None = None) -> DataFrame:
    """One row for each paragraph and parameter (all, or those of only): parameter, num, txt, flag."""
    def entry(name: str, num: Column | None = None, txt: Column | None = None, flag: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(name).alias("parameter"), (num if num is not None else none).cast("double").alias("num"), (txt if txt is not None else none).cast("string").alias("txt"), (flag if flag is not None else none).cast("boolean").alias("flag"))

    have = set(paragraphs.columns)
    entries = {p: entry(p, num=F.coalesce(F.col(c), F.lit(0.0)) if p in ZERO_IF_NULL else F.col(c)) for p, c in NUMBERS.items() if c in have}
    entries |= {p: entry(p, txt=F.col(c)) for p, c in TEXTS.items() if c in have}
    entries |= {p: entry(p, flag=F.coalesce(F.col(c), F.lit(False))) for p, c in FLAGS.items() if c in have}
    entries["terminal_dot"] = entry("terminal_dot", flag=C.stripped("text").endswith(".") & ~C.stripped("text").endswith(".."))
    asked = [e for p, e in entries.items() if only is None or p in only] or [e.cast("struct<parameter:string,num:double,txt:string,flag:boolean>") for e in [F.lit(None)]]
    return paragraphs.select("doc_id", "para_ix", *keep, F.explode(F.filter(F.array(*asked), lambda v: v.isNotNull())).alias("v")).select("doc_id", "para_ix", *keep, "v.*")


def routed(paragraphs: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Paragraphs with every target (all, or those of only) that they belong to."""
    hits = [F.lit(None).cast("string")]
    for target, kind, level, extra in (t for t in TARGETS if only is None or t[0] in only):
        ok = (F.col("paragraph_type") == kind) & C.not_blank("text")
        if level is not None:
            ok = ok & (F.col("heading_level") == level)
        if extra == "structural":
            ok = ok & F.col("is_structural_heading")
        elif extra in ("figure", "table"):
            ok = ok & (F.col("caption_kind") == extra)
        elif extra:
            ok = ok & (F.col("logical_section") == extra)
        hits.append(F.when(F.coalesce(ok, F.lit(False)), F.lit(target)))
    return paragraphs.withColumn("target", F.explode(F.array_distinct(F.filter(F.array(*hits), lambda t: t.isNotNull()))))


def check_parameters(paragraphs: DataFrame, rules: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Values that break a rule of their paragraph's target; cells of header rows and first columns may be bold or italic, and additional text leaves layout to others."""
    keep = ("target", "heading_level", "table_ix", "table_row_ix", "table_col_ix", "caption_kind", "paragraph_type")
    asked = rules.where(F.coalesce("enabled", F.lit(True))).agg(F.collect_set("target"), F.collect_set("parameter")).first()  # names of the rules
    rows = long_values(routed(paragraphs, asked[0]), keep, asked[1])
    wanted = rules.where(F.coalesce("enabled", F.lit(True))).select(*RULE, F.expr("try_variant_get(condition, '$.allow_regular_levels', 'array<int>')").alias("_regular"))
    joined = rows.join(F.broadcast(wanted), ["target", "parameter"])  # the rules of the given profiles
    bad = joined.where(~C.satisfies(F.col("num"), F.col("txt"), F.col("flag")))
    lead_cell = (F.col("paragraph_type") == "table_cell") & ((F.col("table_row_ix") == 0) | (F.col("table_col_ix") == 0)) & F.col("parameter").isin("bold", "italic", "font_color")
    layout = (F.col("target") == "additional_text") & ((F.col("paragraph_type") == "table_cell") | (F.col("caption_kind") == "table")) & F.col("parameter").isin("alignment", "first_line_indent", "left_indent", "right_indent", "line_spacing", "space_before", "space_after")
    regular = (F.col("parameter") == "bold") & F.array_contains("_regular", F.col("heading_level"))
    bad = bad.where(~F.coalesce(lead_cell, F.lit(False)) & ~F.coalesce(layout, F.lit(False)) & ~F.coalesce(regular, F.lit(False)))
    want = F.coalesce(F.array_join("value_list", " or "), C.value_text(F.col("value_num"), F.col("value_str"), F.col("value_bool"), F.col("unit")))
    return findings(bad, want, C.value_text(F.col("num"), F.col("txt"), F.col("flag"), F.col("unit")), table=F.col("table_ix"))


def grouped_cells(violations: DataFrame) -> DataFrame:
    """Findings of table cells as one row for each table and rule: values with their counts, first paragraph."""
    counted = violations.where("table_index is not null").groupBy("doc_id", "profile_id", "rule_id", "parameter", "table_index", "actual").agg(F.count("*").alias("n"), F.min("paragraph_index").alias("ix"))
    return counted.groupBy("doc_id", "profile_id", "rule_id", "parameter", "table_index").agg(F.sum("n").alias("n_cells"), F.min("ix").alias("first_ix"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "actual", "n"))), lambda x: F.concat_ws(" - ", x["actual"], x["n"])), "; ").alias("actual"))


def main_value(paragraphs: DataFrame, column: str, out: str) -> DataFrame:
    """(doc_id, out): the most frequent value of main text."""
    return C.dominant(paragraphs.where("paragraph_type = 'main_text'"), ["doc_id"], column, "para_ix", out).select("doc_id", out)


def _heading_scale(paragraphs: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(doc_id, main, low, n, levels): what the sizes of a document's heading levels follow from, one row a document."""
    levels = paragraphs.where("paragraph_type = 'heading' and heading_level is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("heading_level")).alias("levels"))
    main = main_value(paragraphs, "font_size_pt", "main")
    if low is not None and high is not None:
        main = main.withColumn("main", F.greatest(F.least("main", F.coalesce(high, "main")), F.coalesce(low, "main")))
    return levels.join(main, "doc_id").select("doc_id", "main", F.array_max("levels").alias("low"), F.size("levels").alias("n"), "levels")


def _size_of_level() -> Column:
    step = F.when(F.col("n") == 1, 1).when(F.col("n") == 2, F.col("low") - F.col("heading_level") + 1).otherwise(F.col("low") - F.col("heading_level"))
    return F.when(F.col("heading_level").isNotNull(), F.col("main") + 2 * step)


def heading_sizes(paragraphs: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(doc_id, heading_level, expected): main size (inside limits, if given) plus two for one level; for more, steps of two down to the lowest level."""
    rows = _heading_scale(paragraphs, low, high).withColumn("heading_level", F.explode("levels"))
    return rows.select("doc_id", "heading_level", _size_of_level().alias("expected_size"))


def heading_faults(paragraphs: DataFrame, indent: float | Column | None = None) -> DataFrame:
    """(doc_id, para_ix, parameter, actual, expected, level, profile_id) of the heading rules that need no rule value; one row for each fault.

    indent: the indent of main text that the strategy names, or settings of profiles; where it is null, the most frequent one, else 1.25.
    """
    main_indent, main_spacing = main_value(paragraphs, "first_line_indent_cm", "main_indent"), main_value(paragraphs, "line_spacing", "main_spacing")
    order = Window.partitionBy("doc_id").orderBy("para_ix")
    before = F.coalesce(F.lag("has_page_break").over(order), F.lit(False)) if "has_page_break" in paragraphs.columns else F.lit(False)
    heads = paragraphs.withColumn("_broken", before).where("paragraph_type = 'heading'").join(_heading_scale(paragraphs), "doc_id", "left").withColumn("expected_size", _size_of_level()).join(main_indent, "doc_id", "left").join(main_spacing, "doc_id", "left")
    text = C.stripped("text")
    number = C.first_match(text, r"(?U)^(\d+(?:\.\d+)*)", 1)
    letters = F.regexp_replace("text", r"\P{L}", "")
    first_letter = C.first_match(F.regexp_replace(text, r"(?U)^\d+(?:\.\d+)*\.?\s*", ""), r"\p{L}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    near = lambda a, b: F.abs(a - b) <= 0.05
    centred = F.col("alignment") == "center"
    sides = near(zero("left_indent_cm"), F.lit(0.0)) & near(zero("right_indent_cm"), F.lit(0.0))
    first = zero("first_line_indent_cm")
    indented = lambda main: F.when(centred, near(first, F.lit(0.0)) & sides).otherwise(sides & (near(first, F.lit(0.0)) | near(first, F.coalesce(main, "main_indent", F.lit(1.25)))))
    whose = S.given(indent) if indent is not None else F.array(F.struct(F.lit(None).cast("string").alias("profile_id"), F.lit(None).cast("double").alias("value")))
    policy = S.faults(whose, lambda v: ~indented(v), "heading_indent_policy", C.number_text(first), lambda _: F.when(centred, F.lit("0")).otherwise(F.lit("0 or main indent")))
    own_break = F.coalesce("page_break_before", F.lit(False)) | (F.coalesce("has_page_break", F.lit(False)) if "has_page_break" in paragraphs.columns else F.lit(False)) | F.col("_broken")
    fault = lambda p, bad, actual, expected, level="error": F.when(F.coalesce(bad, F.lit(False)), S.fault(p, actual, expected, level))
    faults = [
        fault("numbering_terminal_dot", number.isNotNull() & ~text.rlike(r"(?Us)^\d+(?:\.\d+)*\. \S"), text, F.lit("number, dot, space, title")),
        fault("starts_with_capital", first_letter.isNotNull() & ~first_letter.rlike(r"\p{Lu}"), first_letter, F.lit("capital letter")),
        fault("heading_font_size_hierarchy", F.abs(F.col("font_size_pt") - F.col("expected_size")) > 0.5, F.col("font_size_pt"), F.col("expected_size")),
        fault("page_break_before", (F.col("heading_level") == 1) & ~own_break, F.lit("no page break"), F.lit("new page")),
        fault("heading_line_spacing_max_main", F.col("line_spacing") > F.col("main_spacing") + 0.05, F.col("line_spacing"), F.col("main_spacing")),
        fault("heading_spacing_order", ~(zero("space_before_pt") > zero("space_after_pt")), zero("space_before_pt"), zero("space_after_pt")),
        fault("heading_space_after_min_single", zero("space_after_pt") <= 0, zero("space_after_pt"), F.lit("more than 0")),
        fault("heading_all_caps", (F.length(letters) >= 8) & ~letters.rlike(r"\p{Ll}"), text, F.lit("not all capitals")),
    ]
    if "runs" in paragraphs.columns:
        written = F.filter("runs", lambda r: C.not_blank(r["text"]))
        coloured = (F.size(written) > 0) & F.forall(written, lambda r: r["font_color"].isNotNull() & (r["font_color"] != "000000"))
        emphasised = F.coalesce(F.col("bold"), F.lit(False)) | F.coalesce(F.col("font_size_pt") >= F.col("expected_size") - 0.5, F.lit(False))
        faults.append(fault("heading_color_only", coloured & ~emphasised, F.lit("colour only"), F.lit("size or bold")))
    return heads.select("doc_id", "para_ix", F.explode(F.concat(F.filter(F.array(*faults), lambda f: f.isNotNull()), policy)).alias("f")).select("doc_id", "para_ix", "f.*")


#: Heading rules that go where the profile sizes or spaces heading roles itself.
ROLE_SWITCHES = {"font_size": ("heading_font_size_hierarchy",), "space_before": ("heading_spacing_order", "heading_space_after_min_single"), "space_after": ("heading_spacing_order", "heading_space_after_min_single")}
ROLES = ("structural_heading", "section_heading", "subsection_heading", "point_heading", "appendix_heading")


def without_role_overrides(rules: DataFrame) -> DataFrame:
    """Rules without the document-wide heading rules that role rules of the same profile replace."""
    pairs = [(p, off) for p, offs in ROLE_SWITCHES.items() for off in offs]
    switch = F.create_map(*(x for p in ROLE_SWITCHES for x in (F.lit(p), F.array(*map(F.lit, ROLE_SWITCHES[p])))))
    off = rules.where(F.col("target").isin(*ROLES) & F.col("parameter").isin(*{p for p, _ in pairs})).select("profile_id", F.explode(switch[F.col("parameter")]).alias("parameter")).distinct()
    return rules.join(off, ["profile_id", "parameter"], "left_anti")


def with_rules(faults: DataFrame, rules: DataFrame, section: Column | None = None, table: Column | None = None) -> DataFrame:
    """Findings of faults (parameter, actual, expected, level) for the rules of the same parameter; faults with a profile_id are those of its rules alone."""
    whose = F.col("profile_id").cast("string") if "profile_id" in faults.columns else F.lit(None).cast("string")
    named = faults.withColumn("_whose", whose).drop("profile_id")
    joined = named.join(F.broadcast(rules.where(F.coalesce("enabled", F.lit(True))).select(*RULE)), "parameter").where("_whose is null or _whose = profile_id").drop("_whose")
    return findings(joined, F.col("expected"), F.col("actual"), F.col("level"), section=section, table=table)


def text_faults(paragraphs: DataFrame) -> DataFrame:
    """Mixed sizes in a paragraph, emphasis methods, additional text, centred text, empty rows and wide spacing."""
    text = F.col("text")
    made = lambda df, p, actual, expected, level="error": df.select("doc_id", "para_ix", F.lit(p).alias("parameter"), actual.cast("string").alias("actual"), F.lit(expected).alias("expected"), F.lit(level).alias("level"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    centred = paragraphs.where((F.col("alignment") == "center") & C.not_blank("text") & ~F.col("paragraph_type").isin("title_page", "table_cell") & ~F.coalesce(F.col("caption_kind") == "table", F.lit(False)))
    off = centred.where((F.abs(zero("first_line_indent_cm")) > 0.05) | (F.abs(zero("left_indent_cm")) > 0.05) | (F.abs(zero("right_indent_cm")) > 0.05))
    out = made(off, "centered_text_no_indents", C.number_text(zero("first_line_indent_cm")), "no indents")
    small = paragraphs.where("paragraph_type in ('caption', 'footnote', 'table_cell')").join(main_value(paragraphs, "font_size_pt", "main"), "doc_id").join(main_value(paragraphs, "font_family", "family"), "doc_id", "left")
    bad = small.where(~((F.abs(F.col("font_size_pt") - (F.col("main") - 2)) <= 0.5) | ((F.abs(F.col("font_size_pt") - F.col("main")) <= 0.5) & (F.col("font_family") != F.col("family")))))
    out = out.unionByName(made(bad, "additional_text_font_size_relative", F.col("font_size_pt"), "main size less 2"))
    order = Window.partitionBy("doc_id").orderBy("para_ix")
    blank = ~C.not_blank("text")
    kind = lambda shift: (F.lag if shift > 0 else F.lead)("paragraph_type").over(order)
    edge = Window.partitionBy("doc_id")
    body = paragraphs.withColumn("_b", blank).withColumn("_lo", F.min(F.when(~blank, F.col("para_ix"))).over(edge)).withColumn("_hi", F.max(F.when(~blank, F.col("para_ix"))).over(edge)).withColumn("_prev", kind(1)).withColumn("_next", kind(-1))
    out = out.unionByName(made(body.where("_b and para_ix > _lo and para_ix < _hi"), "empty_paragraph_between_content", F.lit("empty paragraph"), "none"))
    out = out.unionByName(made(body.where("_b and (_prev = 'heading' or _next = 'heading') and paragraph_type <> 'title_page'"), "empty_paragraph_around_heading", F.lit("empty paragraph"), "none"))
    return out


def spacing_limit_faults(paragraphs: DataFrame, limit: float | Column) -> DataFrame:
    """Spacing above the limit, a value or settings of profiles."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"space_{side}_pt").alias("v")) for side in ("before", "after")))
    rows = paragraphs.select("doc_id", "para_ix", F.explode(sides).alias("s")).select("doc_id", "para_ix", "s.*")
    found = S.faults(S.given(limit), lambda v: F.col("v") > v + 0.5, "additional_spacing_limit", F.concat_ws(" ", "side", C.number_text("v")), C.number_text)
    return rows.select("doc_id", "para_ix", F.explode(found).alias("f")).select("doc_id", "para_ix", "f.*")


def written_runs(paragraphs: DataFrame, *keep: str) -> DataFrame:
    names = [f.name for f in paragraphs.schema["runs"].dataType.elementType.fields]
    return paragraphs.select("doc_id", "para_ix", *keep, F.explode("runs").alias("r")).select("doc_id", "para_ix", *keep, *(F.col(f"r.{n}").alias(f"run_{n}" if n in ("text", "bold", "italic", "font_size_pt") else n) for n in names)).where(C.not_blank("run_text"))


def mixed_sizes(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs whose written runs have several sizes: the dominant one (of equals the one seen first, then the smaller) and up to three that differ. A paragraph's runs stand in its row, so nothing is shuffled."""
    run = lambda r: F.struct(r["run_ix"].alias("run_ix"), r["text"].alias("run_text"), F.bround(r["font_size_pt"], 1).alias("size"))
    sized = F.filter(F.transform(F.filter("runs", lambda r: C.not_blank(r["text"])), run), lambda r: r["size"].isNotNull())
    rows = paragraphs.where("doc_id is not null and para_ix is not null").select("doc_id", "para_ix", sized.alias("_sized"))
    rows = rows.withColumn("_sizes", F.array_distinct(F.transform("_sized", lambda r: r["size"]))).where(F.size("_sizes") > 1)
    of = lambda s: F.filter("_sized", lambda r: r["size"] == s)
    most = F.array_min(F.transform("_sizes", lambda s: F.struct((-F.size(of(s))).alias("n"), F.array_min(F.transform(of(s), lambda r: r["run_ix"])).alias("first_seen"), s.alias("size"))))
    rows = rows.withColumn("top", most["size"]).withColumn("off", F.slice(F.sort_array(F.filter("_sized", lambda r: r["size"] != F.col("top"))), 1, 3))
    return rows.select("doc_id", "para_ix", F.lit("mixed_font_sizes").alias("parameter"), F.array_join(F.transform("off", lambda x: F.concat_ws(": ", x["run_text"], C.number_text(x["size"]))), "; ").alias("actual"), C.number_text("top").alias("expected"), F.lit("error").alias("level"))


def emphasis_methods(paragraphs: DataFrame) -> DataFrame:
    """Documents whose main text is emphasised in more than one way."""
    runs = written_runs(paragraphs.where("paragraph_type = 'main_text'"))
    bold, italic = F.coalesce("run_bold", F.lit(False)), F.coalesce("run_italic", F.lit(False))
    marks = (
        (bold & italic, "bold_italic"), (bold & ~italic, "bold"), (italic & ~bold, "italic"), (F.col("font_color") != "000000", "color"), (F.col("underline"), "underline"), (F.coalesce("strike", F.lit(False)) | F.coalesce("double_strike", F.lit(False)), "strike"), (F.col("small_caps"), "small_caps"),
        (F.coalesce("all_caps", F.lit(False)) | F.col("run_text").rlike(CAPITALS), "all_caps"), (F.coalesce("character_spacing", F.lit(0)) != 0, "character_spacing"),
    )
    ways = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in marks))
    sets = runs.select("doc_id", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("way")).groupBy("doc_id").agg(F.array_sort(F.collect_set("way")).alias("ways")).where(F.size("ways") > 1)
    return sets.select("doc_id", F.lit(None).cast("int").alias("para_ix"), F.lit("emphasis_methods_consistency").alias("parameter"), F.array_join("ways", ", ").alias("actual"), F.lit("one method").alias("expected"), F.lit("warning").alias("level"))


#: Words of so many capitals count as emphasis.
CAPITALS = "[A-ZА-ЯЁ]{8,}"


def run_faults(paragraphs: DataFrame, size_rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, para_ix, parameter, actual, expected, level) of single runs: colour, lines, caps, spacing, emphasis."""
    colours = F.array_distinct(F.transform(F.filter("runs", lambda r: C.not_blank(r["text"])), lambda r: r["font_color"]))
    whole = (F.size(colours) == 1) & F.get(colours, F.lit(0)).isNotNull() & (F.get(colours, F.lit(0)) != "000000")
    runs = written_runs(paragraphs.withColumn("_whole", F.coalesce(whole, F.lit(False))), "_whole", "font_size_pt")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    word = C.first_match("run_text", CAPITALS)
    fault = lambda p, bad, actual, expected: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(p).alias("parameter"), actual.cast("string").alias("actual"), F.lit(expected).alias("expected"), F.lit("error").alias("level")))
    faults = F.array(
        fault("font_color", F.col("font_color") != "000000", F.col("font_color"), "000000"), fault("underline", yes("underline"), F.col("run_text"), "no underline"), fault("strike", yes("strike"), F.col("run_text"), "no strike"), fault("double_strike", yes("double_strike"), F.col("run_text"), "no strike"), fault("small_caps", yes("small_caps"), F.col("run_text"), "no small capitals"),
        fault("all_caps", yes("all_caps"), F.col("run_text"), "no capitals"), fault("character_spacing", F.coalesce("character_spacing", F.lit(0)) != 0, F.col("character_spacing"), "0"), fault("uppercase_emphasis", word.isNotNull(), word, "lower case"),
        fault("emphasis_character_style", yes("has_direct_formatting") & ~yes("has_character_style") & (yes("run_bold") | yes("run_italic") | (F.col("font_color") != "000000")), F.col("run_text"), "character style"),
    )
    return runs.select("doc_id", "para_ix", "run_ix", "_whole", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("f")).select("doc_id", "para_ix", "run_ix", F.col("_whole").alias("whole_paragraph"), "f.*")


def check_runs(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of run rules. A recommended colour rule speaks once, and only of paragraphs in one colour; a run's size is silent where the paragraph's is wrong already."""
    faults = run_faults(paragraphs)
    joined = faults.join(F.broadcast(rules.where(F.coalesce("enabled", F.lit(True)) & (F.col("target") != "table_cell")).select(*RULE)), "parameter")
    soft = (F.col("parameter") == "font_color") & (F.col("modality") == "recommended")
    first = F.row_number().over(Window.partitionBy("doc_id", "para_ix", "profile_id", "rule_id").orderBy("run_ix"))
    kept = joined.withColumn("_first", first).where(~soft | (F.col("whole_paragraph") & (F.col("_first") == 1)))
    out = findings(kept, F.col("expected"), F.col("actual"), F.col("level"))
    size = rules.where("parameter = 'font_size' and target = 'main_text'").select(*RULE)
    runs = written_runs(paragraphs.where("paragraph_type = 'main_text'"), "font_size_pt").withColumn("parameter", F.lit("font_size")).join(F.broadcast(size), "parameter")
    none_t, none_b = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    bad = runs.where(F.col("run_font_size_pt").isNotNull() & ~C.satisfies(F.col("run_font_size_pt"), none_t, none_b) & C.satisfies(F.col("font_size_pt"), none_t, none_b))
    return out.unionByName(findings(bad, C.value_text(F.col("value_num"), F.col("value_str"), none_b, F.col("unit")), C.number_text("run_font_size_pt")))
