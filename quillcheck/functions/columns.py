"""Column functions that the operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import fixed


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def normalised(text: Column | str) -> Column:
    """Lower-cased, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"(?U)\s+", " "))


def normalised_e(text: Column | str) -> Column:
    """normalised(), and ё read as е."""
    return F.translate(normalised(text), "ё", "е")


def not_blank(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike(r"(?U)\S"), F.lit(False))


def first_match(text: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or null."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def once(df: DataFrame, *names: str) -> DataFrame:
    """df with columns that are computed once a row: an explosion of one, as Spark would else compute them anew in each place that reads them."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    made = df.select(*kept, F.explode_outer(F.array(F.struct(*names))).alias("_once"))
    return made.select(*(F.col(f"_once.`{c}`") if c in names else F.col(f"`{c}`") for c in df.columns))


def emu_to_cm(emu: Column | str) -> Column:
    return F.bround(_col(emu) / 360000.0, 3)


def emu_to_pt(emu: Column | str) -> Column:
    return F.bround(_col(emu) / 12700.0, 3)


def mapped(value: Column | str, names: dict) -> Column:
    """The value's name, or the value as it is."""
    value = _col(value)
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(pairs, value), value)


def orientation(width: Column | str, height: Column | str) -> Column:
    return F.when(_col(width) > _col(height), "landscape").when(_col(width).isNotNull() & _col(height).isNotNull(), "portrait")


def page_format(width: Column | str, height: Column | str) -> Column:
    """The first format within the tolerance in either orientation, else the size as text."""
    w, h = _col(width), _col(height)
    near = lambda a, b: F.abs(a - F.lit(b)) <= fixed.PAGE_TOLERANCE_CM + 1e-9
    out = F.when(w.isNotNull() & h.isNotNull(), F.format_string("%s x %s cm", number_text(w), number_text(h)))
    for name, a, b in reversed(fixed.PAGE_FORMATS):
        out = F.when((near(w, a) & near(h, b)) | (near(w, b) & near(h, a)), F.lit(name)).otherwise(out)
    return out


def number_text(value: Column | str) -> Column:
    """At most two decimals, without trailing zeros."""
    number = _col(value).cast("double")
    # most numbers are written by way of a decimal, which is much cheaper; those near zero keep their sign, those beyond it are no such decimals
    usual = F.abs(number).between(0.01, 1e15)
    short = F.rtrim(F.rtrim(F.when(usual, number).cast("decimal(18,2)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(usual, short).when(number.isNotNull(), F.regexp_replace(F.format_string("%.2f", number), r"\.?0+$", ""))


def joined_lines(lines: Column | str) -> Column:
    """Header or footer text: stripped lines that are not empty, one a line."""
    return F.array_join(F.filter(F.transform(_col(lines), stripped), lambda x: x != ""), "\n")


def table_row_text(cells: Column | str) -> Column:
    """Cells of a row, white space collapsed, empty ones left out."""
    return F.array_join(F.filter(F.transform(_col(cells), lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), lambda x: x != ""), " | ")


def nbsp_count(text: Column | str) -> Column:
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit(fixed.NBSP), F.lit("")))


def run_color(value: Column | str, kind: Column | str) -> Column:
    """kind: auto, theme or rgb."""
    return F.when(_col(kind) == "auto", "000000").when(_col(kind) == "rgb", F.upper(_col(value)))


def extension(name: Column | str) -> Column:
    return F.lower(first_match(name, r"\.([^.]+)$", 1))


def style_heading_level(style: Column | str) -> Column:
    """Level that a style's name says, or null."""
    name = F.lower(stripped(style))
    level = F.coalesce(first_match(name, r"(?U)heading\s+(\d+)", 1), first_match(name, r"(?U)заголовок\s+(\d+)", 1)).cast("int")
    roles = F.lit(None).cast("int")
    for marker, n in reversed(fixed.ROLE_LEVELS.items()):
        roles = F.when(F.contains(name, F.lit(marker)), n).otherwise(roles)
    return F.coalesce(level, roles)


def number_heading_level(text: Column | str) -> Column:
    """Parts of the number at the start of a text, or null."""
    number = first_match(stripped(text), fixed.HEADING_NUMBER, 1)
    return F.when(number.isNotNull(), F.regexp_count(number, F.lit(r"\.")) + 1)


def is_structural_heading(text: Column | str) -> Column:
    plain = F.regexp_replace(normalised(text), r"\.+$", "")
    return plain.isin(*fixed.STRUCTURAL_HEADINGS) | plain.rlike(fixed.APPENDIX_HEADING)


def is_list_style(style: Column | str) -> Column:
    return F.coalesce(F.lower(_col(style)).rlike("|".join(fixed.LIST_STYLES)), F.lit(False))


def looks_numbered(text: Column | str, style: Column | str) -> Column:
    plain = stripped(text)
    title = stripped(F.regexp_extract(plain, fixed.HEADING_NUMBER, 2))
    dots = F.regexp_count(F.regexp_replace(title, r"(?U)(?<=\w)\.(?=\w)", ""), F.lit(r"\."))
    return ~is_list_style(style) & (title != "") & (F.length(plain) <= 160) & (dots <= 1)


def looks_styled(text: Column | str) -> Column:
    plain = stripped(text)
    words = F.size(F.split(plain, r"(?U)\s+"))
    return (plain != "") & (F.length(plain) <= 160) & ~((words > 5) & plain.rlike(r"[.!?…]$"))


def list_marker(text: Column | str) -> Column:
    """Struct (marker, type) of a marker typed at the start of a text; both null without one."""
    plain, kind = F.translate(stripped(text), "\uf02d\uf076\uf0b7", "—••"), F.lit(None).cast("string")
    for name, pattern in reversed(fixed.LIST_MARKERS):
        kind = F.when(plain.rlike(pattern), name).otherwise(kind)
    return F.struct(F.when(kind.isNotNull(), F.element_at(F.split(plain, r"(?U)\s+"), 1)).alias("marker"), kind.alias("type"))


def automatic_marker_type(number_format: Column | str, marker: Column | str) -> Column:
    """Type of an automatic list level from its format and its marker text."""
    m = F.translate(stripped(F.coalesce(_col(marker), F.lit(""))), "\uf02d\uf076\uf0b7", "—••")
    return (
        F.when(m.isin("—", "–"), "dash")
        .when(m == "-", "hyphen")
        .when(m.isin("•", "▪", "▫", "‣"), "bullet")
        .when(m.rlike(r"%\d+\)"), "number_bracket")
        .when(m.rlike(r"%\d+\."), "number_dot")
        .when(_col(number_format) == "bullet", "bullet")
        .when(_col(number_format).isin("lowerLetter", "upperLetter", "lowerRoman", "upperRoman"), "letter_dot")
        .otherwise("number_dot")
    )


def caption(text: Column | str) -> Column:
    """Struct (prefix, number, separator, title, kind) of a caption; all null for other texts."""
    plain = stripped(text)
    prefix = first_match(plain, fixed.CAPTION, 1)
    has = prefix.isNotNull()
    return F.struct(
        prefix.alias("prefix"),
        first_match(plain, fixed.CAPTION, 2).alias("number"),
        first_match(plain, fixed.CAPTION, 3).alias("separator"),
        F.when(has, stripped(F.regexp_extract(plain, fixed.CAPTION, 4))).alias("title"),
        F.when(F.lower(prefix).startswith("рис"), "figure").when(has, "table").alias("kind"),
    )


def equation_flags(text: Column | str, equations: Column | str, images: Column | str) -> Column:
    """Struct of equation facts from the text, the number of equation objects and of images."""
    plain, n = stripped(text), _col(equations)
    number = first_match(plain, fixed.EQUATION_NUMBER, 0)
    rest = F.length(stripped(F.regexp_replace(plain, fixed.EQUATION_NUMBER, "")))
    return F.struct((n > 0).alias("has_equation"), n.alias("equation_count"), number.alias("equation_number"), ((n > 0) & ((rest <= 8) | number.isNotNull())).alias("is_standalone_equation"), ((_col(images) > 0) & number.isNotNull()).alias("has_formula_like_image"))


def logical_section(text: Column | str) -> Column:
    """Logical section that a level-1 heading begins."""
    plain = F.regexp_replace(normalised(text), r"\.+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)^\d+(?:\.\d+)*\.?\s+", ""), r"\.+$", "")
    return (
        F.when(plain == "введение", "introduction")
        .when(plain.isin("заключение", "вывод", "выводы"), "conclusion")
        .when(plain.isin(*fixed.REFERENCE_HEADINGS), "references")
        .when(plain.isin("приложение", "приложения") | plain.rlike(fixed.APPENDIX_HEADING), "appendix")
        .when(plain.isin("содержание", "оглавление"), "toc")
        .otherwise("main_part")
    )


def tolerance(unit: Column | str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in fixed.TOLERANCES.items() for x in kv)), _col(unit)), F.lit(fixed.OTHER_TOLERANCE))


def close_to(a: Column, b: Column, tol: Column) -> Column:
    return F.abs(a - b) <= F.greatest(tol, 1e-9 * F.greatest(F.abs(a), F.abs(b)))


def satisfies(num: Column, text: Column, flag: Column, rule: str = "") -> Column:
    """Whether an actual value (one of num, text, flag is set) meets a rule's value columns; a missing value never does.

    rule: prefix of the columns operator, unit, value_num, value_str, value_bool, value_list.
    """
    r = lambda name: F.col(f"{rule}{name}")
    tol = tolerance(r("unit"))
    folded = lambda c: F.lower(F.trim(c))
    shown = F.coalesce(text, F.when(num.isNotNull(), number_text(num)))

    def equal(want_num: Column, want_text: Column, want_flag: Column) -> Column:
        return (
            F.when(flag.isNotNull() | want_flag.isNotNull(), F.coalesce(flag, F.coalesce(num, F.lit(0.0)) != 0) == F.coalesce(want_flag, F.coalesce(want_num, F.lit(0.0)) != 0))
            .when(num.isNotNull() & want_num.isNotNull(), close_to(num, want_num, tol))
            .otherwise(folded(shown) == folded(F.coalesce(want_text, F.when(want_num.isNotNull(), number_text(want_num)))))
        )

    none = F.lit(None)
    listed = F.exists(r("value_list"), lambda x: equal(x.try_cast("double"), x, none.cast("boolean")))
    met = (
        F.when(num.isNull() & text.isNull() & flag.isNull(), False)
        .when(r("operator") == "equals", equal(r("value_num"), r("value_str"), r("value_bool")))
        .when(r("operator") == "min", num >= r("value_num") - tol)
        .when(r("operator") == "max", num <= r("value_num") + tol)
        .when(r("operator") == "in", listed)
        .otherwise(False)
    )
    return F.coalesce(met, F.lit(False))


def value_text(num: Column, text: Column, flag: Column, unit: Column) -> Column:
    """A value for readers, with its unit."""
    shown = F.when(flag.isNotNull(), F.when(flag, "yes").otherwise("no")).when(num.isNotNull(), number_text(num)).otherwise(F.coalesce(text, F.lit("not set")))
    return F.when(num.isNotNull() & unit.isNotNull() & ~unit.isin("ratio", "lines"), F.concat_ws(" ", shown, unit)).otherwise(shown)


def dominant(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """One row for each group: its most frequent value that is not null; of equals the one seen first by order, then the smaller."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(out)).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first_seen", out))
    return counts.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "first_seen").withColumnRenamed("n", f"{out}_count")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian plural form for a count."""
    return F.when((n % 100).between(11, 14), many).when(n % 10 == 1, one).when((n % 10).between(2, 4), few).otherwise(many)


def parameter_label(parameter: Column | str) -> Column:
    """A parameter's name for readers."""
    return F.replace(_col(parameter), F.lit("_"), F.lit(" "))


def parameter_unit(parameter: Column | str) -> Column:
    """The unit of a parameter's numbers, or null."""
    p = _col(parameter)
    return F.when(p.rlike("(^|_)(margin|indent|distance)$"), "cm").when(p == "line_spacing", "ratio").when(p.rlike("font_size$|^space_|spacing_limit$"), "pt").when(p.rlike("_px$"), "px")


def parameter_kind(parameter: Column | str) -> Column:
    """What a parameter speaks of."""
    p = _col(parameter)
    kinds = (("^(figure|image)_", "image"), ("^table_|^no_continuation_table", "table"), ("^heading_|_heading$|numbering_terminal_dot|starts_with_capital", "heading"), ("^(page|header|footer)_|_margin$|^margins_|page_number", "page"), ("^list_|_list_", "list"), ("^equation|_equation", "equation"), ("^footnote", "footnote"), ("^references_|_structure$|_required_content$|^toc_", "structure"))
    out = F.lit("text")
    for pattern, kind in reversed(kinds):
        out = F.when(p.rlike(pattern), kind).otherwise(out)
    return out
