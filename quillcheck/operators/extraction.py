"""Rules out of regulation texts: blocks, sections, fragments, statements, candidates, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.sources.staging import partitions_of, staged, staged_by

# Markers, patterns, keyword tables.
PAGE_NUMBER, TOC_LINE = r"(?U)^\s*\d+\s*$", r"(?U)[.…·⋯]{3,}\s*\d+\s*$"
LIST_MARKER = r"(?U)^\s*([-−–—•▪▫‣]|\d+[).]|[а-яА-Я][).])\s+"
SECTION_NUMBERS = (r"(?U)^\s*(\d+(?:\.\d+)+)\.?\s+\S", r"(?U)^\s*(\d+)\.?\s+[А-ЯЁ]")
EXAMPLE_OR_NOTE = r"(?iU)\b(Пример|Примеры|Например|Примечание|Примечания)\b[:.]?"
MANDATORY = ("должен", "должна", "должно", "должны", "не допускается", "недопустимо", "запрещается")
RECOMMENDED = ("рекомендуется", "следует", "желательно", "предпочтительно")
ALLOWED = ("допускается", "можно", "разрешается", "допустимо")
PROHIBITION = ("не допускается", "недопустимо", "запрещается", "не должны")
CONTEXT_PARTS = ("содержание", "введение", "заключение", "список источников", "список использованных источников", "приложения")
NUMBER = r"(\d+(?:[.,]\d+)?)"
RANGE = rf"(?iU){NUMBER}\s*[–—-]\s*{NUMBER}\s*(пт|пункт\w*|см|мм)?"
EITHER = rf"(?iU){NUMBER}\s+(?:или|;)\s+{NUMBER}"
RELATIVE = rf"(?iU)на\s+{NUMBER}\s*(пт|пункт\w*|см|мм)\s+(меньше|больше)"
PAGE_PARAMETERS = ("page_format", "page_orientation", "top_margin", "bottom_margin", "left_margin", "right_margin", "header_distance", "footer_distance")
SUPPORTED = (*PAGE_PARAMETERS, "font_family", "font_size", "font_color", "bold", "italic", "alignment", "line_spacing", "first_line_indent", "left_indent", "right_indent", "space_before", "space_after", "keep_with_next", "keep_together", "page_break_before")
#: parameter, keywords, value pattern, unit, kind of value, names of values
EXTRACTORS = (
    ("font_size", ("кегль", "размер шрифта", "размером", "кеглем"), rf"(?iU){NUMBER}\s*(?:пт|пункт)?", "pt", "number", {}),
    ("font_family", ("гарнитура", "шрифт"), r"(?iU)(Times New Roman|Arial|Calibri|Aptos|Courier New|Cambria)", None, "string", {}),
    ("top_margin", ("верхнее поле", "поле сверху", "верхнего поля"), rf"(?iU){NUMBER}\s*(см|мм)", "cm", "length", {}),
    ("bottom_margin", ("нижнее поле", "поле снизу", "нижнего поля"), rf"(?iU){NUMBER}\s*(см|мм)", "cm", "length", {}),
    ("left_margin", ("левое поле", "поле слева", "левого поля"), rf"(?iU){NUMBER}\s*(см|мм)", "cm", "length", {}),
    ("right_margin", ("правое поле", "поле справа", "правого поля"), rf"(?iU){NUMBER}\s*(см|мм)", "cm", "length", {}),
    ("line_spacing", ("интервал", "интерлиньяж", "межстрочный интервал"), r"(?iU)(полуторн\w*|одинарн\w*|1[.,]5|1(?:[.,]0)?)", None, "named_number", {"полуторн": "1.5", "одинарн": "1.0"}),
    ("font_color", ("цвет",), r"(?iU)(ч[её]рн\w*|черн\w*|000000)", None, "named", {"черн": "000000", "чёрн": "000000"}),
    ("first_line_indent", ("абзацный отступ", "отступ первой строки", "красная строка"), rf"(?iU){NUMBER}\s*(см|мм)", "cm", "length", {}),
    ("alignment", ("выравнивание", "выравнивают", "выравнивать", "выравнивается", "выравненный"), r"(?iU)(по ширине|по центру|по левому(?: краю)?|слева|центрирован\w*)", None, "named", {"по ширине": "justify", "по центру": "center", "по левому": "left", "слева": "left", "центрирован": "center"}),
    ("page_format", ("формат", "формата"), r"(?iU)(A4|А4|A5|А5)", None, "named", {"a4": "A4", "а4": "A4", "a5": "A5", "а5": "A5"}),
    ("bold", ("полужирн", "жирн"), r"(?iU)(полужирн\w*|жирн\w*)", None, "true", {}),
    ("italic", ("курсив",), r"(?iU)(курсив\w*)", None, "true", {}),
)
SANITY = {"font_size": (6.0, 24.0), "top_margin": (0.5, 5.0), "bottom_margin": (0.5, 5.0), "left_margin": (0.5, 5.0), "right_margin": (0.5, 5.0), "line_spacing": (0.8, 3.0), "first_line_indent": (0.0, 3.0)}
_S = "(см|мм)?"
#: parameters, pattern on the lower-cased statement, group of the number and of its unit
MARGINS = (
    (("top_margin", "bottom_margin"), rf"(?U){NUMBER}\s*{_S}\s*[—–-]\s*в\s+верхн\w+\s+и\s+нижн\w+\s+част[иья]\s+страниц"),
    (("left_margin",), rf"(?U){NUMBER}\s*{_S}\s*[—–-]\s*в\s+лев\w+\s+част[иья]\s+страниц"),
    (("right_margin",), rf"(?U){NUMBER}\s*{_S}\s*[—–-]\s*в\s+прав\w+\s+част[иья]\s+страниц"),
    (("top_margin", "bottom_margin"), rf"(?U)сверху\s*,\s*снизу\s*[—–-]\s*{NUMBER}\s*{_S}"),
    (("left_margin",), rf"(?U)\bслева[^—–-]*[—–-]\s*{NUMBER}\s*{_S}"),
    (("right_margin",), rf"(?U)\bсправа[^—–-]*[—–-]\s*{NUMBER}\s*{_S}"),
    (("top_margin",), rf"(?U)(?:сверху|верхн\w*)[^—–-]*[—–-]\s*{NUMBER}\s*{_S}"),
    (("bottom_margin",), rf"(?U)(?:снизу|нижн\w*)[^—–-]*[—–-]\s*{NUMBER}\s*{_S}"),
)
#: Structural rules: parameter, target, groups of words (one of each group must occur), words that must not occur, value, modality (None: of the statements), confidence
STRUCTURAL = (
    ("conclusion_required_content", "document", (("заключение",), ("должно содержать",)), (), "results and conclusions", None, 0.68),
    ("initial_verb_form", "introduction_tasks", (("задач",), ("неопределенн", "неопределен", "что нужно сделать")), (), "infinitive", "mandatory", 0.78),
    ("heading_english_not_allowed", "document", (("заголов",), ("английск",), ("недопуст", "не допуска")), (), "true", "mandatory", 0.74),
    ("list_marker_dash_required", "document", (("в качестве маркера",), ("только тире",)), (), "true", "mandatory", 0.74),
    ("hyphen_instead_of_dash", "main_text", (("тире",), ("длинн", "дефис"), ("коротк", "предел", "между числами")), (), "true", "mandatory", 0.68),
    ("dash_spacing", "main_text", (("тире",), ("длинн", "дефис"), ("коротк", "предел", "между числами")), (), "true", "mandatory", 0.68),
    ("numeric_range_dash", "main_text", (("тире",), ("длинн", "дефис"), ("коротк", "предел", "между числами")), (), "true", "mandatory", 0.68),
    ("number_sign_symbol", "main_text", (("латинской буквы n",), ("не допуска",)), (), "true", "mandatory", 0.72),
    ("russian_quotes", "main_text", (("парные кавычки", "«…»"),), (), "true", "mandatory", 0.66),
    ("no_dot_after_udc_keywords_table_title", "document", (("точк",), ("подпис", "рисун", "названи"), ("не став", "не ставить")), (), "true", "mandatory", 0.66),
    ("figure_caption_position", "document", (("рисун",), ("подпис", "названи"), ("под рисун", "под изображ", "снизу")), (), "below", "mandatory", 0.68),
    ("image_keep_with_next", "document", (("рисун",), ("подпис", "названи"), ("отрыв", "отдел", "вместе", "одной страниц")), (), "true", "mandatory", 0.68),
    ("figure_caption_alignment", "document", (("рисун",), ("подпис", "названи"), ("центр",)), (), "center", "mandatory", 0.68),
    ("figure_caption_prefix", "figure_caption", (("рисунок",), ("подпис", "названи")), (), "Рисунок", "mandatory", 0.6),
    ("figure_caption_separator", "figure_caption", (("рисун",), ("подпис", "названи"), ("тире",), ("номер",)), (), "dash", "mandatory", 0.58),
    ("figure_caption_terminal_dot", "figure_caption", (("рисун",), ("подпис", "названи"), ("точк",), ("не став",)), (), "false", "mandatory", 0.64),
    ("image_after_first_reference", "document", (("рисун",), ("ссыл",)), (), "true", "mandatory", 0.62),
    ("table_caption_position", "document", (("назван",), ("над таблиц", "перед таблиц")), (), "above", "mandatory", 0.68),
    ("table_caption_alignment", "table_caption", (("таблиц",), ("назван",), ("по лев",)), (), "left", "mandatory", 0.58),
    ("table_caption_prefix", "table_caption", (("таблица",), ("назван",)), (), "Таблица", "mandatory", 0.56),
    ("table_caption_separator", "table_caption", (("таблиц",), ("тире",), ("назван",)), (), "dash", "mandatory", 0.56),
    ("table_caption_terminal_dot", "table_caption", (("таблиц",), ("назван",), ("точк",), ("не став",)), (), "false", "mandatory", 0.6),
    ("table_header_required", "document", (("таблиц",), ("головк",)), ("повтор", "дублиров"), "true", "mandatory", 0.66),
    ("table_header_required", "document", (("таблиц",), ("шапк",)), ("повтор", "дублиров"), "true", "mandatory", 0.62),
    ("table_grid_style", "document", (("таблиц",), ("сетк", "границ")), (), "true", "mandatory", 0.62),
    ("table_title_keep", "document", (("таблиц",), ("отрыв", "отдел", "вместе", "одной страниц"), ("назван", "заголов")), (), "true", "mandatory", 0.68),
    ("table_repeat_header", "document", (("таблиц",), ("повтор", "дублиров"), ("головк", "заголов", "шапк", "строк")), (), "true", "mandatory", 0.6),
    ("table_text_spacing_indent", "document", (("таблиц",), ("текст",), ("одинарн", "абзацн", "отступ")), (), "true", "mandatory", 0.62),
    ("automatic_list_numbering_required", "list_item", (("автоматическ",), ("нумерац",), ("списк",)), (), "true", "mandatory", 0.5),
    ("list_punctuation_policy", "list_item", (("после двоеточ",), ("точка с запятой", "строчной буквы"), ("спис",)), (), "true", "mandatory", 0.48),
    ("forbidden_phrases", "main_text", (("не использовать",), ("повелительного наклонения", "оценочной лексики", "местоимения 1")), (), "phrases", "recommended", 0.7),
    ("front_matter_page_numbers_hidden_until_intro", "document", (("титульн",), ("содержание",), ("номер",), ("не простав",), ("введение",)), (), "true", "mandatory", 0.55),
    ("toc_headings_match_text", "document", (("содержание",), ("заголовки",), ("точно повторять",)), (), "true", None, 0.62),
    ("title_page_topic_match", "document", (("титульн",), ("название",), ("должно соответствовать",)), (), "true", None, 0.62),
    ("document_language", "document", (("на русском языке", "русский язык"), ("вкр", "защит")), (), "русский язык", None, 0.62),
    ("section_conclusions_required", "document", (("в конце каждого раздела",), ("вывод",)), (), "true", None, 0.62),
    ("first_main_section_review_required", "document", (("первым разделом",), ("обзор",)), (), "true", None, 0.62),
    ("additional_section_required", "document", (("дополнительного раздела",), ("должно быть включено",)), (), "true", None, 0.62),
)
#: Words of which a section must have one for any structural candidate: those of the first group of each rule, and of the rules that are no list of words.
STRUCTURAL_WORDS = tuple(dict.fromkeys((*(w for _, _, groups, *_ in STRUCTURAL for w in groups[0]), "структур", "состав", "введени", "источник", "страниц")))
UNCHECKED = ("title_page_topic_match", "document_language", "section_conclusions_required", "first_main_section_review_required", "additional_section_required", "recommended_work_volume")
STRUCTURE_ELEMENTS = (
    "титульный лист", "задание", "календарный план", "реферат", "аннотацию", "аннотация", "содержание", "определения", "обозначения", "сокращения", "введение", "основная часть", "заключение", "список использованных источников", "приложения",
)
VOLUME = r"(?iU)для\s+([^–—-]+)[–—-]\s*(\d+)\s*[–—-]\s*(\d+)\s+страниц"
LEAST_REFERENCES = r"(?U)(?:минимум|не\s+менее|не\s+меньше|необходим[оа]?\s+не\s+менее)\s+(\d+)\s+источник"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def typed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (source_document, block_ix, text) with text collapsed, empty ones dropped, block_type and list_marker."""
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    rows = C.once(blocks.withColumn("text", text), "text").where("text <> ''")
    kind = F.when(F.col("text").rlike(PAGE_NUMBER), "page_number").when(F.col("text").rlike(TOC_LINE), "toc").when(F.col("text").rlike(LIST_MARKER), "list_item").otherwise("paragraph")
    return C.once(rows.withColumn("block_type", kind), "block_type").withColumn("list_marker", C.first_match("text", LIST_MARKER, 1))


def is_bold_font(name: Column | str) -> Column:
    return F.lower(F.col(name) if isinstance(name, str) else name).rlike("bold|semibold|black")


def is_reference_block() -> Column:
    """Small print that refers elsewhere."""
    plain = C.normalised("text")
    return F.coalesce(F.col("font_size") <= 12.5, F.lit(False)) & (plain.rlike(r"^\d+\s+") | plain.rlike(r"^(url|http|– url|- url)") | plain.contains("федер. агентство") | plain.contains("регулированию и метрологии"))


def section_number(text: Column | str = "text", patterns: tuple[str, ...] = SECTION_NUMBERS) -> Column:
    return F.coalesce(*(C.first_match(text, p, 1) for p in patterns))


def without_contents_pages(blocks: DataFrame) -> DataFrame:
    """Without pages titled contents; block_ix counted anew."""
    pages = blocks.where(C.normalised("text").isin("оглавление", "содержание") & F.col("page_number").isNotNull()).select("source_document", "page_number").distinct()
    rows = blocks.join(pages, ["source_document", "page_number"], "left_anti")
    return rows.withColumn("block_ix", F.row_number().over(Window.partitionBy("source_document").orderBy("block_ix")) - 1)


def merged_continuations(blocks: DataFrame) -> DataFrame:
    """Paragraphs that go on from the block before, on the same page, are joined to it; a hyphen at the end is taken out."""
    order = Window.partitionBy("source_document").orderBy("block_ix")
    before, kind, page = F.lag("text").over(order), F.lag("block_type").over(order), F.lag("page_number").over(order)
    goes_on = (F.col("block_type") == "paragraph") & (kind == "paragraph") & (page == F.col("page_number")) & section_number().isNull() & ~before.rlike(r"[.:;!?]$")
    rows = blocks.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    parts = rows.groupBy("source_document", "_g").agg(F.sort_array(F.collect_list(F.struct("block_ix", "text"))).alias("p"), F.first("block_type").alias("block_type"), F.first("page_number").alias("page_number"))
    glued = F.aggregate("p", F.lit(""), lambda a, x: F.when(a == "", x["text"]).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-+$", ""), x["text"])).otherwise(F.concat(a, F.lit(" "), x["text"])))
    return parts.select("source_document", (F.col("_g") - 1).cast("int").alias("block_ix"), glued.alias("text"), "block_type", "page_number")


def sections(blocks: DataFrame, patterns: tuple[str, ...] = SECTION_NUMBERS) -> DataFrame:
    """(source_document, section_ix, number, text): each numbered line opens a section; lines before the first are left out."""
    lines = blocks.where(~F.col("block_type").isin("toc", "page_number"))
    order = Window.partitionBy("source_document").orderBy("block_ix")
    rows = lines.withColumn("_n", section_number("text", patterns)).withColumn("section_ix", F.count("_n").over(order)).where("section_ix > 0")
    grouped = rows.groupBy("source_document", "section_ix").agg(F.max("_n").alias("number"), F.sort_array(F.collect_list(F.struct("block_ix", "text"))).alias("t"))
    return grouped.select("source_document", F.col("section_ix").cast("int").alias("section_ix"), "number", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def context_of(t: Column) -> Column:
    """The kind of text that a lower-cased statement speaks of, or null."""
    has = lambda *w: _any(t, w)
    head = has("заголов")
    return (
        F.when(has("основн") & has("текст"), "main_text")
        .when(head & _any(t, CONTEXT_PARTS), "structural_heading")
        .when(has("структурн") & has("раздел", "элемент"), "structural_heading")
        .when(has("формат страниц", "поля", "поле"), "page")
        .when(has("стил") & head, "heading")
        .when(head & has("1-го", "1 уровня"), "section_heading")
        .when(has("параграф") | (head & has("2-го", "2 уровня")), "subsection_heading")
        .when(has("пункт") | (head & has("3-го", "3 уровня")), "point_heading")
        .when(has("рисунк", "подпис"), "caption")
        .when(has("таблиц"), "table_cell")
        .when(has("снос"), "footnote")
    )


def modality_of(t: Column) -> Column:
    return F.when(_any(t, MANDATORY), "mandatory").when(_any(t, RECOMMENDED), "recommended").when(_any(t, ALLOWED), "allowed")


def fragments(section_rows: DataFrame) -> DataFrame:
    """(source_document, section_ix, number, fragment_ix, fragment_type, text, context, modality): requirement lines, and the notes and examples after them."""
    noted = _any(F.lower("text"), ("пример", "примечани"))  # in each of the words that the pattern looks for
    rows = C.once(section_rows.withColumn("_noted", noted), "_noted").withColumn("_m", F.when(F.col("_noted"), C.all_matches("text", EXAMPLE_OR_NOTE, 1))).withColumn("_p", F.when(F.col("_noted"), F.split("text", EXAMPLE_OR_NOTE, -1)).otherwise(F.array("text")))
    notes = rows.where("_noted").select("source_document", "section_ix", "number", F.posexplode(F.zip_with("_m", F.slice("_p", 2, F.greatest(F.size("_m"), F.lit(1))), lambda m, p: F.struct(m.alias("m"), C.stripped(p).alias("t")))).alias("at", "x")).where("x.t <> ''")
    notes = notes.select("source_document", "section_ix", "number", (F.col("at") + 1_000_000).alias("fragment_ix"), F.when(F.lower("x.m").startswith("прим") & ~F.lower("x.m").startswith("пример"), "note").otherwise("example").alias("fragment_type"), F.col("x.t").alias("text"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("modality"))
    lines = rows.select("source_document", "section_ix", "number", F.posexplode(F.split(F.element_at("_p", 1), "\n")).alias("line", "raw"))
    lines = lines.withColumn("marked", F.col("raw").rlike(LIST_MARKER)).withColumn("text", C.stripped(F.when(F.col("marked"), F.regexp_replace("raw", LIST_MARKER, "")).otherwise(F.col("raw"))))
    lines = C.once(lines, "marked", "text").where("text <> ''")
    past = Window.partitionBy("source_document", "section_ix").orderBy("line")
    opens = F.col("text").endswith(":")
    lines = lines.withColumn("_lower", F.lower("text"))  # a column of its own, so that the words below are looked for in one copy
    lines = lines.withColumn("_own", context_of(F.col("_lower"))).withColumn("modality", F.last(modality_of(F.col("_lower")), ignorenulls=True).over(past))
    lines = lines.withColumn("_context", F.last(F.when(opens, F.col("_own")), ignorenulls=True).over(past)).withColumn("_prefix", F.last(F.when(opens, F.col("text")), ignorenulls=True).over(past)).where(~opens)
    pieces = lines.select("*", F.posexplode(F.when(F.contains("text", F.lit(";")), F.split("text", r"(?U);(?=\s*[а-яА-ЯA-Z]|$)", -1)).otherwise(F.array("text"))).alias("piece", "part")).withColumn("part", F.btrim("part", F.lit(" .")))
    pieces = C.once(pieces, "part").where((F.col("part") != "") & ~F.lower("part").rlike("^(не)?правильно"))
    text = F.when(F.col("marked") & F.col("_prefix").isNotNull(), F.concat_ws(": ", "_prefix", "part")).otherwise(F.col("part"))
    context = F.coalesce("_own", F.when(F.col("marked"), F.col("_context")))
    return pieces.select("source_document", "section_ix", "number", (F.col("line") * 1000 + F.col("piece")).alias("fragment_ix"), F.lit("requirement").alias("fragment_type"), text.alias("text"), context.alias("context"), "modality").unionByName(notes)


def statement_type(t: Column, fragment_type: Column) -> Column:
    return (
        F.when(fragment_type.isin("note", "example"), fragment_type)
        .when(_any(t, PROHIBITION), "prohibition")
        .when(_any(t, ("должен", "должна", "должно", "должны", "обязательно")), "requirement")
        .when(_any(t, (*RECOMMENDED, "как правило")), "recommendation")
        .when(_any(t, (*ALLOWED, "может")), "permission")
        .when(t.rlike("^(если |при |в случае )"), "condition")
        .otherwise("requirement")
    )


def statements(fragment_rows: DataFrame) -> DataFrame:
    """Fragments cut into atomic statements: lines, table cells with their first cell, sentences, clauses."""
    trimmed = lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" ."))

    def cells(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, r" \| "), trimmed), lambda c: c != "")
        return F.when(F.contains(line, F.lit(" | ")) & (F.size(parts) > 1), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda c: F.concat(F.get(parts, F.lit(0)), F.lit(": "), c))).otherwise(F.array(line))

    flat = F.flatten(F.transform(F.split("text", "\n"), cells))
    flat = F.flatten(F.transform(flat, lambda x: F.split(x, r"(?U)(?<=[.!?])\s+(?=[А-ЯЁA-Z])")))
    flat = F.filter(F.transform(F.flatten(F.transform(flat, lambda x: F.when(F.contains(x, F.lit(";")), F.split(x, r"(?U);\s+")).otherwise(F.array(x)))), trimmed), lambda x: x != "")
    rows = fragment_rows.select("source_document", "section_ix", "number", "fragment_ix", "fragment_type", "context", F.col("modality").alias("inherited"), F.posexplode(flat).alias("statement_ix", "text"))
    rows = rows.withColumn("_lower", F.lower("text")).withColumn("statement_type", statement_type(F.col("_lower"), F.col("fragment_type"))).drop("_lower")
    by_type = F.when(F.col("statement_type").isin("requirement", "prohibition"), "mandatory").when(F.col("statement_type") == "recommendation", "recommended").when(F.col("statement_type") == "permission", "allowed").otherwise(F.col("inherited"))
    return rows.withColumn("modality", by_type).drop("inherited")


def _read(rows: DataFrame) -> DataFrame:
    """Statements with their text lower-cased and normalised, and what they speak of: columns, so that each is made once a row."""
    return rows.withColumn("_lower", F.lower("text")).withColumn("_plain", C.normalised("text")).withColumn("_about", _about())


def target_of(parameter: Column) -> Column:
    return F.when(parameter.isin(*PAGE_PARAMETERS), "page").otherwise(F.col("_about"))


def _about() -> Column:
    t = F.col("_plain")
    has = lambda *w: _any(t, w)
    return (
        F.when(F.col("context").isNotNull(), F.col("context"))
        .when(has("заголов", "раздел", "подраздел"), "heading")
        .when(has("таблиц"), "table_cell")
        .when(has("подпис", "рисун"), "caption")
        .when(has("сноск"), "footnote")
        .when(has("дополнительн") & has("текст"), F.lit(None).cast("string"))
        .when((has("основн") & has("текст")) | has("весь текст", "по всему тексту", "текст работы"), "main_text")
        .when(has("страниц", "лист", "поле", "формат"), "page")
    )


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _length(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit) == "мм", value / 10).otherwise(value)


def _candidate(parameter: str, operator: str = "equals", num: Column | None = None, txt: Column | None = None, values: Column | None = None, unit: str | None = None, status: str | None = None, confidence: float | None = None, target: str | None = None, delta: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(parameter).alias("parameter"), F.lit(operator).alias("operator"), (num if num is not None else none).cast("double").alias("value_num"), (txt if txt is not None else none).cast("string").alias("value_str"), (values if values is not None else none).cast("array<double>").alias("value_list"), F.lit(unit).cast("string").alias("unit"), F.lit(status).cast("string").alias("own_status"), F.lit(confidence).cast("double").alias("own_confidence"), F.lit(target).cast("string").alias("own_target"), (delta if delta is not None else none).cast("double").alias("delta"))


def _direct() -> list[Column]:
    """Candidates of margins, spacing, indents, sizes in context and keeping together; null where a pattern is absent."""
    t = F.col("_lower")
    found = lambda p, g=1: C.first_match(t, p, g)
    has = lambda *w: _any(t, w)
    when = lambda cond, c: F.when(F.coalesce(cond, F.lit(False)), c)
    out = []
    page = F.coalesce(F.col("context") == "page", F.lit(False))
    sides = t.rlike(r"(?U)\b(?:сверху|снизу|слева|справа)\b[^0-9]{0,80}[—–-]\s*\d")
    margins = (page | has("пол", "части страницы") | sides) & ~(has("отступ") & ~has("пол") & ~page)
    for parameters, pattern in MARGINS:
        value = _length(_number(found(pattern)), found(pattern, 2))
        out += [when(margins & found(pattern).isNotNull(), _candidate(p, num=value, unit="cm", target="page")) for p in parameters]
    spacing = has("интервал")
    lines = has("межстроч", "междустроч", "интерлиньяж")
    out.append(when(spacing & lines & t.rlike(r"(?U)\bполуторн\w*"), _candidate("line_spacing", num=F.lit(1.5))))
    out.append(when(spacing & lines & ~t.rlike(r"(?U)\bполуторн\w*") & t.rlike(r"(?U)\bодинарн\w*"), _candidate("line_spacing", num=F.lit(1.0))))
    for pattern, names in ((rf"(?U)перед\s+и\s+после\s*[—–-]\s*{NUMBER}", ("space_before", "space_after")), (rf"(?U)перед\s*[—–-]\s*{NUMBER}", ("space_before",)), (rf"(?U)после\s*[—–-]\s*{NUMBER}", ("space_after",))):
        out += [when(spacing & found(pattern).isNotNull(), _candidate(n, num=_number(found(pattern)), unit="pt")) for n in names]
    indent = has("отступ")
    cell = F.col("_about") == "table_cell"
    out += [when(indent & cell & t.rlike(r"(?U)(?:без|нет)\s+\w*\s*отступ"), _candidate(n, num=F.lit(0.0), unit="cm", target="table_cell")) for n in ("first_line_indent", "left_indent", "right_indent")]
    out.append(when(indent & t.rlike(r"(?U)отступ\s+первой\s+строки\s*[—–-]\s*(нет|0)"), _candidate("first_line_indent", num=F.lit(0.0), unit="cm")))
    left = rf"(?U)отступ\s+слева\s*[—–-]\s*{NUMBER}\s*{_S}"
    out.append(when(indent & found(left).isNotNull(), _candidate("left_indent", num=_length(_number(found(left)), found(left, 2)), unit="cm")))
    out.append(when(has("не отрывать от следующего"), _candidate("keep_with_next", txt=F.lit("true"))))
    out.append(when(has("не разрывать"), _candidate("keep_together", txt=F.lit("true"))))
    out.append(when(has("начинать с новой страницы") & ~F.coalesce(F.col("_about") == "heading", F.lit(False)), _candidate("page_break_before", txt=F.lit("true"))))
    sized = has("кегль", "размер шрифта", "размером", "шрифта")
    either = rf"(?U)(?:кегль|размер шрифта|шрифт)[^0-9]{{0,40}}{NUMBER}\s*(?:пт|пункт\w*)?\s*(?:или|/|,)\s*{NUMBER}"
    one = F.coalesce(found(rf"(?U)[—–-]\s*{NUMBER}\s*(?:пт|пункт\w*)?\s*$"), found(rf"(?U)(?:кегль|размер шрифта)[^0-9]{{0,40}}{NUMBER}"))
    out.append(when(sized & found(either).isNotNull(), _candidate("font_size", "in", values=F.array(_number(found(either)), _number(found(either, 2))), unit="pt")))
    out.append(when(sized & found(either).isNull() & one.isNotNull(), _candidate("font_size", num=_number(one), unit="pt")))
    return out


def _extracted() -> list[Column]:
    """For each extractor whose keyword occurs: a relative value, else a range, else two values, else one."""
    t, text = F.col("_plain"), F.col("text")
    has = lambda *w: _any(t, w)
    relative, span, either = C.first_match(text, RELATIVE), C.first_match(text, RANGE), C.first_match(text, EITHER)
    out = []
    for parameter, keywords, pattern, unit, kind, names in EXTRACTORS:
        target = target_of(F.lit(parameter))
        go = has(*keywords)
        if parameter == "font_size":
            go = go & ~has("уровн")
        elif parameter == "line_spacing":
            go = go & ~(has("перед", "после") & ~has("межстроч", "интерлиньяж"))
        elif parameter == "first_line_indent":
            go = go & ~(has("отступ первой строки") & has("нет"))
        elif parameter in ("bold", "italic"):
            heading = F.coalesce(target.endswith("heading"), F.lit(False))
            emphasis = has("выделение", "выделяются", "акцентировать внимание", "может использоваться", "может быть использован")
            go = go & ~(emphasis & ~heading) & ~F.coalesce(target, F.lit("main_text")).isin(*(("main_text", "page") if parameter == "bold" else ("main_text",)))
        delta = _number(F.regexp_extract(text, RELATIVE, 1)) * F.when(F.lower(F.regexp_extract(text, RELATIVE, 3)).startswith("меньше"), -1).otherwise(1)
        rel = F.when(relative.isNotNull(), F.array(_candidate(parameter, txt=relative, unit=unit, status="unsupported", confidence=0.45, delta=delta)))
        choices = [rel]
        if kind in ("number", "length"):
            a, b, u = _number(F.regexp_extract(text, RANGE, 1)), _number(F.regexp_extract(text, RANGE, 2)), F.regexp_extract(text, RANGE, 3)
            a, b = (_length(a, u), _length(b, u)) if kind == "length" else (a, b)
            choices.append(F.when(span.isNotNull(), F.array(_candidate(parameter, "min", num=F.least(a, b), unit=unit), _candidate(parameter, "max", num=F.greatest(a, b), unit=unit))))
        if kind in ("number", "named_number"):
            a, b = _number(F.regexp_extract(text, EITHER, 1)), _number(F.regexp_extract(text, EITHER, 2))
            fits = either.isNotNull() & (F.lit(True) if kind == "number" else (a <= 3) & (b <= 3))
            choices.append(F.when(fits, F.array(_candidate(parameter, "in", values=F.array(a, b), unit=unit))))
        raw = C.first_match(text, pattern, 1)
        if kind == "number":
            value = _candidate(parameter, num=_number(raw), unit=unit)
        elif kind == "length":
            value = _candidate(parameter, num=_length(_number(raw), C.first_match(text, pattern, 2)), unit=unit)
        elif kind == "true":
            value = _candidate(parameter, txt=F.lit("true"), unit=unit)
        else:
            named = raw
            for start, name in reversed(names.items()):
                named = F.when(F.lower(raw).startswith(start), F.lit(name)).otherwise(named)
            value = _candidate(parameter, num=_number(named), unit=unit) if kind == "named_number" else _candidate(parameter, txt=named, unit=unit)
        choices.append(F.when(raw.isNotNull(), F.array(value)))
        out.append(F.when(F.coalesce(go, F.lit(False)), F.coalesce(*choices)))
    return out


#: Words of which a statement must have one, lower-cased, for any of the candidates of _direct.
DIRECT_WORDS = ("верхн", "нижн", "лев", "прав", "сверху", "снизу", "интервал", "отступ", "не отрывать от следующего", "не разрывать", "начинать с новой страницы", "кегль", "размер", "шрифт")


def _worth() -> Column:
    """Whether a statement has any word that a candidate needs; cheap, and kept apart from the patterns."""
    return _any(F.col("_lower"), DIRECT_WORDS) | _any(F.col("_plain"), tuple(w for _, words, *_ in EXTRACTORS for w in words))


def _readings(rows: DataFrame) -> DataFrame:
    """(text, context, _about, c): the candidates of each different text and context that has any; written once, so that Spark knows how many there are."""
    both = F.concat(F.filter(F.array(*_direct()), lambda c: c.isNotNull()), F.flatten(F.filter(F.array(*_extracted()), lambda c: c.isNotNull())))
    worth = C.once(rows.select("text", "context", F.lower("text").alias("_lower"), C.normalised("text").alias("_plain")), "_lower", "_plain").where(_worth())
    read = _read(worth.select("text", "context").distinct()).select("text", "context", "_about", both.alias("_c"))
    return staged(C.once(read, "_c").where(F.size("_c") > 0), "extraction-readings")


def value_text() -> Column:
    return F.coalesce(F.array_join(F.transform("value_list", lambda x: C.number_text(x)), " / "), C.number_text("value_num"), F.col("value_str"))


def _deduplicated(rows: DataFrame, *keys: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("section_ix", "fragment_ix", "statement_ix", "place"))
    return rows.withColumn("_f", first).where("_f = 1").drop("_f")


def candidates(statement_rows: DataFrame) -> DataFrame:
    """Rule candidates of requirement statements, the first of each target, parameter, operator and value of a document.

    Each different statement is read once, whatever the number of documents that hold it.
    """
    rows = statement_rows.where("fragment_type = 'requirement' and statement_type not in ('note', 'example')")
    found = _readings(rows).withColumnsRenamed({"text": "_t", "context": "_x"})
    rows = rows.join(found, (F.col("text") == F.col("_t")) & F.col("context").eqNullSafe(F.col("_x")))
    rows = rows.select("source_document", "section_ix", "number", "fragment_ix", "statement_ix", "text", "_about", "modality", F.posexplode("_c").alias("place", "c")).select("*", "c.*").drop("c")
    target = F.coalesce("own_target", target_of(F.col("parameter")))
    supported = F.col("parameter").isin(*SUPPORTED)
    rows = rows.withColumn("target", target).withColumn("status", F.when(~supported, "unsupported").otherwise(F.coalesce("own_status", F.when(target.isNull(), "needs_review").otherwise("extracted"))))
    rows = rows.withColumn("confidence", F.when(~supported, 0.35).otherwise(F.coalesce("own_confidence", F.when(target.isNull(), 0.5).otherwise(0.8)))).withColumn("value_text", value_text())
    rows = _deduplicated(rows, "source_document", "target", "parameter", "operator", "value_text")
    return rows.select("source_document", "section_ix", "fragment_ix", "statement_ix", "place", "target", "parameter", "operator", "value_num", "value_str", "value_list", "value_text", "unit", F.coalesce("modality", F.lit("unknown")).alias("modality"), F.col("text").alias("source_text"), F.col("number").alias("source_section"), "confidence", "status", "delta")


def structural_candidates(statement_rows: DataFrame, longest: int = 1200) -> DataFrame:
    """Candidates of whole sections: every structural rule whose words occur, least references, parts, contents of the introduction and volumes."""
    rows = statement_rows.where("fragment_type = 'requirement'")
    parts = rows.groupBy("source_document", "number").agg(F.min("section_ix").alias("section_ix"), F.sort_array(F.collect_list(F.struct("section_ix", "fragment_ix", "statement_ix", "text", "modality"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    parts = parts.select("source_document", "number", "section_ix", text.alias("full"), C.normalised(text).alias("text"), "s", F.get(F.filter(F.transform("s", lambda x: x["modality"]), lambda m: m.isNotNull()), F.lit(0)).alias("modality"))
    parts = C.once(parts, "full", "text").where(_any(F.col("text"), STRUCTURAL_WORDS))
    t = F.col("text")
    made = lambda cond, parameter, target, value, modality, confidence: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(parameter).alias("parameter"), F.lit(target).alias("target"), (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value_str"), F.lit(modality).cast("string").alias("own"), F.lit(confidence).alias("confidence")))
    out = []
    for parameter, target, groups, banned, value, modality, confidence in STRUCTURAL:
        cond = F.lit(True)
        for g in groups:
            cond = cond & _any(t, g)
        out.append(made(cond & ~_any(t, banned) if banned else cond, parameter, target, value, modality, confidence))
    intro = t.contains("имеет следующую структуру") | t.contains("следующие структурные части") | (t.contains("состав") & t.rlike(r"состав\w*.{0,80}(?:работ|диссертац|вкр|курсов)")) | (t.contains("состоит") & t.rlike(r"(?:работа|диссертац\w*|вкр).{0,40}состоит"))
    named = F.array(*map(F.lit, STRUCTURE_ELEMENTS))  # in the order in which the statements name them
    elements = F.array_join(F.array_distinct(F.flatten(F.transform("s", lambda x: F.filter(named, lambda e: F.contains(C.normalised(x["text"]), e))))), "; ")
    out.append(made(_any(t, ("структур", "состав")) & _any(t, ("включ", "состоит")) & intro & ~t.contains("библиографическое описание") & (elements != ""), "required_document_structure", "document", elements, None, 0.7))
    items = F.array_join(F.filter(F.array(F.when(t.contains("актуальност"), "обоснование актуальности"), F.when(t.contains("цел") & t.contains("задач"), "цели и задачи"), F.when(t.contains("объект") & t.contains("предмет"), "объект и предмет")), lambda e: e.isNotNull()), "; ")
    out.append(made(t.contains("введени") & (items != ""), "introduction_required_content", "document", items, None, 0.68))
    least = F.when(t.contains("источник"), C.first_match(t, LEAST_REFERENCES, 1))
    out.append(made(least.isNotNull(), "references_min_count", "document", least, "mandatory", 0.78))
    volume = VOLUME
    volumes = F.array_join(F.transform(F.regexp_extract_all("full", F.lit(volume), F.lit(0)), lambda x: F.concat(F.trim(F.regexp_extract(x, volume, 1)), F.lit(": "), F.regexp_extract(x, volume, 2), F.lit("-"), F.regexp_extract(x, volume, 3))), "; ")
    out.append(made(t.contains("страниц") & (volumes != ""), "recommended_work_volume", "document", volumes, "recommended", 0.68))
    made = C.once(parts.select("source_document", "section_ix", "number", "full", "modality", F.array(*out).alias("_c")), "_c")
    each = made.select("source_document", "section_ix", "number", "full", "modality", F.posexplode(F.filter("_c", lambda c: c.isNotNull())).alias("place", "c")).select("*", "c.*").drop("c")
    none = F.lit(None)
    return each.select("source_document", "section_ix", F.lit(0).alias("fragment_ix"), F.lit(0).alias("statement_ix"), (F.col("place") + 1000).alias("place"), "target", "parameter", F.lit("equals").alias("operator"), none.cast("double").alias("value_num"), "value_str", none.cast("array<double>").alias("value_list"), F.col("value_str").alias("value_text"), none.cast("string").alias("unit"), F.coalesce("own", "modality", F.lit("unknown")).alias("modality"), F.left("full", F.lit(longest)).alias("source_text"), F.col("number").alias("source_section"), "confidence", F.when(F.col("parameter").isin(*UNCHECKED), "unsupported").otherwise("extracted").alias("status"), none.cast("double").alias("delta"))


def with_modality(rows: DataFrame) -> DataFrame:
    """Unknown modalities from the sentence that holds the value, if exactly one kind of marker is there; else they need a look."""
    sentences = F.split("source_text", r"(?U)(?<=[.!?])\s+")
    token = F.lower("value_text")
    holds = F.get(F.filter(sentences, lambda s: F.contains(F.lower(s), token) | F.contains(F.lower(s), F.replace(token, F.lit("."), F.lit(",")))), F.lit(0))
    unknown = F.col("modality") == "unknown"
    rows = rows.withColumn("_holds", F.when(unknown, F.lower(F.coalesce(holds, "source_text"))))
    t = F.col("_holds")
    kinds = {"mandatory": _any(t, (*MANDATORY, "обязательно", "не должны")), "recommended": _any(t, (*RECOMMENDED, "как правило")), "allowed": _any(t, (*ALLOWED, "может"))}
    one = sum((k.cast("int") for k in kinds.values()), F.lit(0)) == 1
    found = F.when(one, F.coalesce(*(F.when(k, F.lit(n)) for n, k in kinds.items())))
    rows = rows.withColumn("_found", found)
    found = F.col("_found")
    return rows.withColumn("status", F.when(unknown & found.isNull(), "needs_review").otherwise(F.col("status"))).withColumn("modality", F.when(unknown, F.coalesce(found, F.lit("unknown"))).otherwise(F.col("modality"))).drop("_holds", "_found")


def without_subsets(rows: DataFrame, slot: tuple[str, ...]) -> DataFrame:
    """rows without those whose value_list lies inside a longer one of the same slot.

    By an inverted index of the slots' different lists: a list that holds another holds its rarest value too, so each list is looked up
    under its rarest value only, and the lists found there are compared whole. Empty lists lie inside any other.
    """
    key = F.struct(*slot)
    lists = rows.where("value_list is not null").select(key.alias("_slot"), F.array_sort(F.array_distinct("value_list")).alias("_list"), F.size("value_list").alias("_size")).distinct()
    index = lists.select("_slot", "_list", "_size", F.explode("_list").alias("_value"))
    often = index.groupBy("_slot", "_value").agg(F.count("*").alias("_often"))
    keyed = lambda df: df.join(often.select(F.col("_slot").alias("_s"), F.col("_value").alias("_v"), "_often"), F.col("_slot").eqNullSafe(F.col("_s")) & (F.col("_value") == F.col("_v"))).drop("_s", "_v")
    rarest = keyed(index).groupBy("_slot", "_list", "_size").agg(F.min_by("_value", F.struct("_often", "_value")).alias("_value"))
    holders = index.select(F.col("_slot").alias("_s"), F.col("_value").alias("_v"), F.col("_list").alias("_longer"), F.col("_size").alias("_long"))
    inside = (F.col("_size") < F.col("_long")) & (F.size(F.array_except("_list", "_longer")) == 0)
    held = rarest.join(holders, F.col("_slot").eqNullSafe(F.col("_s")) & (F.col("_value") == F.col("_v"))).where(inside).select("_slot", "_list", "_size")
    others = lists.groupBy("_slot").agg(F.max("_size").alias("_most")).where("_most > 0").select(F.col("_slot").alias("_s"))
    empty = lists.where(F.size("_list") == 0).join(others, F.col("_slot").eqNullSafe(F.col("_s")), "left_semi").select("_slot", "_list", "_size")
    gone = held.unionByName(empty).distinct().select(F.col("_slot").alias("_s"), F.col("_list").alias("_l"), F.col("_size").alias("_n"))
    same = key.eqNullSafe(F.col("_s")) & F.array_sort(F.array_distinct("value_list")).eqNullSafe(F.col("_l")) & (F.size("value_list") == F.col("_n"))
    return rows.join(gone, same, "left_anti")


def verified(rows: DataFrame, least: float = 0.6, partitions: int | None = None) -> DataFrame:
    """Confidence by sanity of values, target and modality; duplicates and subsets removed; conflicts marked.

    The rows are written once before the subsets are looked for, as that reads them in several branches; by document in so many partitions, if they are given.
    """
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for p, (a, b) in SANITY.items():
        low, high = F.when(F.col("parameter") == p, a).otherwise(low), F.when(F.col("parameter") == p, b).otherwise(high)
    values = F.coalesce("value_list", F.when(F.col("value_num").isNotNull(), F.array("value_num")), F.array().cast("array<double>"))
    outside = F.coalesce(low.isNotNull() & F.exists(values, lambda v: (v < low) | (v > high)), F.lit(False))
    edge = F.coalesce(low.isNotNull() & F.exists(values, lambda v: (v == low) | (v == high)), F.lit(False))
    rows = rows.withColumn("_outside", outside).withColumn("_edge", edge)
    outside, edge = F.col("_outside"), F.col("_edge")
    score = 1.0 - 0.3 * outside.cast("int") - 0.2 * (edge & ~outside).cast("int") - 0.3 * F.col("target").isNull().cast("int") - 0.3 * (F.col("modality") == "unknown").cast("int")
    rows = rows.withColumn("confidence", F.when(F.col("status") == "unsupported", F.col("confidence")).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)))
    rows = rows.withColumn("status", F.when((F.col("status") == "extracted") & (outside | (F.col("confidence") < least)), "needs_review").otherwise(F.col("status")))
    slot = ("source_document", "target", "parameter", "operator", "modality")
    best = F.row_number().over(Window.partitionBy(*slot, "value_text").orderBy(F.desc(F.coalesce(F.size("value_list"), F.lit(0))), F.desc("confidence"), "section_ix", "fragment_ix", "statement_ix", "place"))
    rows = rows.withColumn("_b", best).where("_b = 1").drop("_b", "_outside", "_edge")
    rows = staged(rows, "extraction-candidates") if partitions is None else staged_by(rows, "extraction-candidates", "source_document", partitions)
    rows = without_subsets(rows, slot)
    many = F.size(F.collect_set(F.when((F.col("operator") == "equals") & (F.col("status") != "unsupported"), F.col("value_text"))).over(Window.partitionBy("source_document", "target", "parameter"))) > 1
    return rows.withColumn("_many", many).withColumn("status", F.when(F.col("_many") & (F.col("operator") == "equals") & (F.col("status") != "unsupported") & F.col("target").isNotNull(), "conflict").otherwise(F.col("status"))).drop("_many")


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Typed blocks of pages: small print and contents pages left out, continuations joined."""
    rows = typed_blocks(blocks)
    if "font_size" in blocks.columns:
        rows = rows.where(~F.coalesce(is_reference_block(), F.lit(False)))
    return merged_continuations(without_contents_pages(rows))


def extracted(blocks: DataFrame) -> DataFrame:
    """Regulation blocks to verified candidates; id names a candidate inside its document. Blocks with page_number are rows of pages."""
    partitions = partitions_of(blocks.count())  # blocks are dealt by document once, and what is written stays so
    blocks = blocks.repartition(partitions, "source_document")
    typed = page_blocks(blocks) if "page_number" in blocks.columns else typed_blocks(blocks)
    found = staged_by(sections(typed), "extraction-sections", "source_document", partitions)  # lines and notes are read from them
    rows = staged_by(statements(fragments(found)), "extraction-statements", "source_document", partitions)  # two branches read them
    every = verified(with_modality(candidates(rows).unionByName(structural_candidates(rows))), partitions=partitions)
    return every.withColumn("id", F.concat_ws("-", "section_ix", "fragment_ix", "statement_ix", "place", "parameter", "operator"))


def confirmed(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted ids (source_document, id) become confirmed if supported, with target and modality; all others are rejected."""
    yes = accepted.select("source_document", "id", F.lit(True).alias("_yes")).distinct()
    ok = F.col("_yes") & (F.col("status") != "unsupported") & F.col("target").isNotNull() & (F.col("modality") != "unknown")
    return rows.join(yes, ["source_document", "id"], "left").withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "confirmed").otherwise("rejected")).drop("_yes")


def category_of(parameter: Column) -> Column:
    return F.when(parameter.isin("initial_verb_form", "forbidden_phrases", "completed_action_form"), "linguistic").when(parameter.isin("required_document_structure", "references_min_count", "heading_english_not_allowed", "toc_headings_match_text", "introduction_required_content", "conclusion_required_content", "front_matter_page_numbers_hidden_until_intro"), "structure").when(parameter.isin(*SUPPORTED), "formatting").otherwise("text")


def profile_rules(rows: DataFrame) -> DataFrame:
    """Rules of confirmed candidates, one profile for each source document."""
    order = F.row_number().over(Window.partitionBy("source_document").orderBy("section_ix", "fragment_ix", "statement_ix", "place"))
    slug = F.translate(F.lower(F.concat_ws("_", "target", "parameter", "operator", "value_text")), ". -", "___")
    return rows.where("status = 'confirmed'").select(F.col("source_document").alias("profile_id"), slug.alias("rule_id"), (order - 1).alias("ordinal"), category_of(F.col("parameter")).alias("category"), "target", "parameter", "operator", "value_num", "value_str", F.lit(None).cast("boolean").alias("value_bool"), F.transform("value_list", lambda x: C.number_text(x)).alias("value_list"), "unit", "modality", "source_text", "source_section", F.lit(True).alias("enabled"))


def views(rows: DataFrame) -> DataFrame:
    """One row for each target of a document: its candidates for readers, in order, with counts."""
    acceptable = ~F.col("status").isin("unsupported", "conflict") & F.col("target").isNotNull()
    view = F.struct("section_ix", "fragment_ix", "statement_ix", "place", F.concat_ws(" ", "parameter", "operator", "value_text", "unit").alias("rule"), "modality", "status", F.round(F.col("confidence") * 100).cast("int").alias("percent"), acceptable.alias("can_accept"))
    return rows.groupBy("source_document", F.coalesce("target", F.lit("no target")).alias("target_group")).agg(F.count("*").alias("n"), F.count_if(acceptable).alias("n_acceptable"), F.sort_array(F.collect_list(view)).alias("candidates"))
