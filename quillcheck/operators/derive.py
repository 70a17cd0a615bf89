"""Column work that turns raw attributes of blocks into the paragraph, section, image and table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.functions import columns as C
from quillcheck.functions import fixed
from quillcheck.functions.running import running
from quillcheck.sources.staging import staged

ALIGNMENTS = {"LEFT": "left", "CENTER": "center", "RIGHT": "right", "JUSTIFY": "justify", "both": "justify", "start": "left", "end": "right"}
STYLE_VALUES = ("alignment", "font_family", "font_size_pt", "bold", "italic", "first_line_indent_cm", "left_indent_cm", "right_indent_cm", "line_spacing", "space_before_pt", "space_after_pt", "keep_with_next", "keep_together", "page_break_before")


#: Documents with at most so many rows of styles are followed inside one row.
STYLES_IN_A_ROW = 256


def style_alignments(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, alignment): the first alignment on a style's chain of base styles, which is as long as it is; chains that end in a circle or in a style that is not there have none.

    By pointer doubling: after r rounds every style points to the style that is two to the power of r steps up, or where its chain ends. The
    styles of a document with at most STYLES_IN_A_ROW rows stand in one array, so these documents are shuffled once; larger ones
    are followed by joins. A repeated style counts once, the least of its rows; rows without doc_id have their own alignment only.
    """
    rows = styles.where("style_id is not null").select("doc_id", "style_id", "alignment", "based_on")
    placed = rows.where("doc_id is not null")
    sizes = placed.groupBy("doc_id").count()
    large = sizes.where(F.col("count") > STYLES_IN_A_ROW).select("doc_id")
    link = F.min(F.struct("alignment", "based_on")).alias("link")
    own = rows.where("doc_id is null").groupBy("doc_id", "style_id").agg(link).select("doc_id", "style_id", "link.alignment").where("alignment is not null")
    longest = sizes.agg(F.max("count")).first()[0] or 0
    if longest <= STYLES_IN_A_ROW:
        return _followed_in_rows(placed).unionByName(own)
    joined = _followed_by_joins(placed.join(large, "doc_id", "left_semi").groupBy("doc_id", "style_id").agg(link).select("doc_id", "style_id", "link.*"))
    return _followed_in_rows(placed.join(large, "doc_id", "left_anti")).unionByName(joined).unionByName(own)


def _followed_in_rows(rows: DataFrame) -> DataFrame:
    made = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("style_id", "alignment", "based_on"))).alias("_all"))
    made = made.select("doc_id", F.filter("_all", lambda x, i: (i == 0) | (x["style_id"] != F.get("_all", i - 1)["style_id"])).alias("_links"))
    made = made.withColumn("_ids", F.transform("_links", lambda x: x["style_id"]))
    # places from 1; a chain's end points to itself
    up = F.transform("_links", lambda x, i: F.coalesce(F.nullif(F.when(x["alignment"].isNull(), F.array_position("_ids", x["based_on"])).cast("int"), F.lit(0)), i + 1))
    rounds = F.sequence(F.lit(1), F.lit(STYLES_IN_A_ROW.bit_length()))
    made = made.withColumn("_up", up).withColumn("_end", F.aggregate(rounds, F.col("_up"), lambda now, _: F.transform(now, lambda t: F.get(now, t - 1))))
    each = made.select("doc_id", F.explode(F.zip_with("_ids", "_end", lambda s, t: F.struct(s.alias("style_id"), F.get("_links", t - 1)["alignment"].alias("alignment")))).alias("_x"))
    return each.select("doc_id", "_x.*").where("alignment is not null")


def _followed_by_joins(now: DataFrame) -> DataFrame:
    now = staged(now.select("doc_id", "style_id", "alignment", F.when(F.col("alignment").isNull(), F.col("based_on")).alias("up")), "style-links")
    longest = now.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range((longest - 1).bit_length()):
        above = now.select("doc_id", F.col("style_id").alias("up"), F.col("alignment").alias("_alignment"), F.col("up").alias("_up"))
        opened = now.where("up is not null").join(above, ["doc_id", "up"], "left").select("doc_id", "style_id", F.col("_alignment").alias("alignment"), F.when(F.col("_alignment").isNull(), F.col("_up")).alias("up"))
        now = staged(now.where("up is null").unionByName(opened), "style-links")
    return now.where("alignment is not null").select("doc_id", "style_id", "alignment")


def first_written_run() -> Column:
    return F.get(F.filter("runs", lambda r: C.not_blank(r["text"])), F.lit(0))


def paragraph_effects(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Effective attributes: a paragraph's own, else its style's, else those of Normal; fonts start from the first written run."""
    flat = styles.select("doc_id", "style_id", *(F.col(c).alias(f"s_{c}") for c in STYLE_VALUES))
    normal = styles.where("style_id = 'Normal'").select("doc_id", *(F.col(c).alias(f"n_{c}") for c in STYLE_VALUES))
    chain = style_alignments(styles)
    df = paragraphs.join(flat, ["doc_id", "style_id"], "left").join(normal, "doc_id", "left").join(chain.withColumnRenamed("alignment", "c_alignment"), ["doc_id", "style_id"], "left")
    run = first_written_run()
    own = lambda c: F.coalesce(F.col(c), F.col(f"s_{c}"), F.col(f"n_{c}"))
    written = F.filter("runs", lambda r: C.not_blank(r["text"]))
    every = lambda c: F.when(F.size(written) > 0, F.forall(written, lambda r: F.coalesce(r[c], F.col(f"s_{c}"), F.col(f"n_{c}"), F.lit(False))))
    out = {
        "alignment": F.coalesce(C.mapped("alignment", ALIGNMENTS), "c_alignment", "n_alignment", F.lit("left")),
        "font_family": F.coalesce(run["font_family"], "s_font_family", "n_font_family"),
        "font_size_pt": F.coalesce(run["font_size_pt"], "s_font_size_pt", "n_font_size_pt"),
        "first_run_bold": F.coalesce(run["bold"], "s_bold", "n_bold"),
        "bold": every("bold"),
        "italic": every("italic"),
        **{c: F.coalesce(own(c), F.lit(0.0)) for c in ("first_line_indent_cm", "left_indent_cm", "right_indent_cm")},
        **{c: own(c) for c in ("space_before_pt", "space_after_pt", "keep_with_next", "keep_together", "page_break_before")},
        "line_spacing": F.coalesce(F.when(F.col("line_rule") == "auto", F.col("line_spacing")), "s_line_spacing", "n_line_spacing"),
    }
    return df.select(*(F.col(c) for c in paragraphs.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def run_effects(runs: DataFrame, styles: DataFrame) -> DataFrame:
    """Runs (one a row: doc_id, char_style, style_id, own values) with effective booleans and size, colour, spacing, space counts and where the formatting comes from."""
    by = lambda p, key: styles.select("doc_id", F.col("style_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("bold", "italic", "font_size_pt")))
    df = runs.join(by("c", "char_style"), ["doc_id", "char_style"], "left").join(by("s", "style_id"), ["doc_id", "style_id"], "left")
    df = df.join(styles.where("style_id = 'Normal'").select("doc_id", *(F.col(c).alias(f"n_{c}") for c in ("bold", "italic", "font_size_pt"))), "doc_id", "left")
    whole = lambda c: F.coalesce(F.col(c), F.col(f"c_{c}"), F.col(f"s_{c}"), F.col(f"n_{c}"))
    plain = F.lower(F.trim(F.coalesce("char_style", F.lit(""))))
    out = {
        "has_character_style": ~plain.isin("", "default paragraph font"),
        "has_direct_formatting": F.coalesce(F.col("bold").cast("string"), F.col("italic").cast("string"), F.col("font_size_pt").cast("string"), F.col("color_value")).isNotNull(),
        "bold": whole("bold"),
        "italic": whole("italic"),
        "font_size_pt": whole("font_size_pt"),
        "font_color": C.run_color("color_value", "color_kind"),
        "character_spacing": F.col("character_spacing").try_cast("int"),
        "nonbreaking_space_count": C.nbsp_count("text"),
        "has_nonbreaking_space": C.nbsp_count("text") > 0,
    }
    return df.select(*(F.col(c) for c in runs.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def break_flags(breaks: Column | str = "breaks", section: Column | str = "has_section_mark") -> list[Column]:
    """From an array of break types (null or other: line)."""
    b = F.col(breaks) if isinstance(breaks, str) else breaks
    kind = lambda x: F.coalesce(x, F.lit("line"))
    return [F.exists(b, lambda x: ~kind(x).isin("page", "column")).alias("has_line_break"), F.exists(b, lambda x: kind(x) == "page").alias("has_page_break"), F.exists(b, lambda x: kind(x) == "column").alias("has_column_break"), F.coalesce(F.col(section) if isinstance(section, str) else section, F.lit(False)).alias("has_section_break")]


def classified(paragraphs: DataFrame) -> DataFrame:
    """Adds caption and list-marker columns, paragraph_type, heading_level and heading flags. Needs text, style_name, is_automatic_list (and paragraph_type of rows that have one by origin)."""
    for name, kind in (("style_name", "string"), ("is_automatic_list", "boolean"), ("table_ix", "int"), ("origin_type", "string")):
        if name not in paragraphs.columns:
            paragraphs = paragraphs.withColumn(name, F.lit(None).cast(kind))
    df = paragraphs.withColumn("_c", C.caption("text")).withColumn("_m", C.list_marker("text"))
    df = df.withColumns({f"caption_{k}": F.col(f"_c.{k}") for k in ("kind", "number", "prefix", "title")} | {"list_marker": F.col("_m.marker"), "list_marker_type": F.col("_m.type")}).drop("_c", "_m")
    by_style, by_number = C.style_heading_level("style_name"), C.number_heading_level("text")
    structural = F.coalesce(C.is_structural_heading("text"), F.lit(False))
    styled = by_style.isNotNull() & (by_number.isNotNull() | C.looks_styled("text"))
    made = lambda t, level=None, s=False, n=False: F.struct(F.lit(t).alias("type"), (F.lit(level).cast("int") if level is None or isinstance(level, int) else level.cast("int")).alias("level"), F.lit(s).alias("structural"), (F.lit(n) if isinstance(n, bool) else n).alias("numbered"))
    kind = (
        F.when(F.col("origin_type").isNotNull(), F.struct(F.col("origin_type").alias("type"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("structural"), F.lit(False).alias("numbered")))
        .when(~C.not_blank("text"), made("empty"))
        .when(F.col("caption_kind").isNotNull(), made("caption"))
        .when(C.is_list_style("style_name") | F.coalesce("is_automatic_list", F.lit(False)) | F.col("list_marker_type").isNotNull(), made("list_item"))
        .when(structural, made("heading", 1, True))
        .when(F.coalesce(styled, F.lit(False)), made("heading", F.coalesce(by_number, by_style), False, by_number.isNotNull()))
        .when(F.coalesce(C.looks_numbered("text", "style_name"), F.lit(False)), made("heading", by_number, False, True))
        .otherwise(made("main_text"))
    )
    df = df.withColumn("_k", kind)
    return df.withColumns({"paragraph_type": F.col("_k.type"), "heading_level": F.col("_k.level"), "is_structural_heading": F.col("_k.structural"), "is_numbered_heading": F.col("_k.numbered")}).drop("_k", "origin_type")


def with_title_page(paragraphs: DataFrame, most: int = 40, least: int = 3) -> DataFrame:
    """Marks the rows before the first stop line of a document as title page if they have enough of its words."""
    order = Window.partitionBy("doc_id").orderBy("para_ix")
    plain = C.normalised("text")
    bare = F.regexp_replace(plain, r"\.+$", "")
    stop = F.coalesce(bare.isin(*fixed.TITLE_PAGE_STOPS) | bare.rlike(r"(?U)^\d+(?:\.\d+)*\s+\S+"), F.lit(False))
    df = paragraphs.withColumn("_n", F.row_number().over(order)).withColumn("_stop", F.max(stop).over(order))
    lead = (F.col("_n") <= most) & ~F.col("_stop")
    words = [F.max(lead & F.contains(plain, F.lit(w))).alias(f"_w{i}") for i, w in enumerate(fixed.TITLE_PAGE_WORDS)]
    marks = [F.max(lead & plain.rlike(p)).alias(f"_w{len(words) + i}") for i, p in enumerate((fixed.TITLE_PAGE_YEAR, fixed.TITLE_PAGE_CITY))]
    score = sum(F.coalesce(F.col(f"_w{i}"), F.lit(False)).cast("int") for i in range(len(words) + len(marks)))
    scores = df.groupBy("doc_id").agg(*words, *marks).select("doc_id", (score >= least).alias("_title"))
    hit = lead & F.col("_title")
    return df.join(scores, "doc_id").withColumn("paragraph_type", F.when(hit, "title_page").otherwise(F.col("paragraph_type"))).withColumn("heading_level", F.when(~hit, F.col("heading_level"))).drop("_n", "_stop", "_title")


def with_logical_sections(paragraphs: DataFrame) -> DataFrame:
    """The section of the last level-1 heading, other before the first; cells and footnotes have none, the title page its own."""
    heading = (F.col("paragraph_type") == "heading") & (F.col("heading_level") == 1)
    filled = running(paragraphs, ["doc_id"], "para_ix", lasts={"_section": F.when(heading, C.logical_section("text"))})
    kind = F.when(F.col("paragraph_type") == "title_page", "title_page").when(~F.col("paragraph_type").isin("footnote", "table_cell"), F.coalesce("_section", F.lit("other")))
    return filled.withColumn("logical_section", kind).drop("_section")


def with_footnotes(body: DataFrame, footnotes: DataFrame) -> DataFrame:
    """Footnote texts that are not empty, as rows after a document's last paragraph."""
    last = body.groupBy("doc_id").agg(F.max("para_ix").alias("_last"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("footnote_ix"))
    rows = footnotes.where(C.not_blank("text")).join(last, "doc_id", "left").select("doc_id", (F.coalesce("_last", F.lit(-1)) + number).cast("int").alias("para_ix"), C.stripped("text").alias("text"), F.lit("footnote").alias("origin_type"))
    return body.unionByName(rows, allowMissingColumns=True)


def footnote_settings(settings: DataFrame) -> DataFrame:
    """(doc_id, footnote_number_format, footnote_number_restart) from the settings text."""
    part = F.regexp_extract("settings", r"(?s)<w:footnotePr>(.*?)</w:footnotePr>", 1)
    value = lambda tag: C.first_match(part, rf'<w:{tag} w:val="([^"]*)"', 1)
    return settings.select("doc_id", value("numFmt").alias("footnote_number_format"), value("numRestart").alias("footnote_number_restart"))


def automatic_markers(paragraphs: DataFrame, numbering: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds marker text and type of automatic lists: number id -> abstract numbering -> level; number_dot where the chain breaks."""
    df = paragraphs.join(numbering, ["doc_id", "num_id"], "left").join(levels, ["doc_id", "abstract_num_id", "ilvl"], "left")
    automatic = F.col("num_id").isNotNull()
    kind = F.when(F.col("level_format").isNull() & F.col("level_text").isNull(), "number_dot").otherwise(C.automatic_marker_type("level_format", "level_text"))
    return df.select(*paragraphs.columns, automatic.alias("is_automatic_list"), F.when(automatic, F.col("level_text")).alias("automatic_marker"), F.when(automatic, kind).alias("automatic_marker_type"))


def table_contexts(body: DataFrame) -> DataFrame:
    """(doc_id, table_ix, title_para_ix, paragraph_before_ix) of tables in body order; body has block_ix, is_table, para_ix, caption_kind, text.

    A table's title is the last table caption, or continuation line, since the table before it.
    """
    order = Window.partitionBy("doc_id").orderBy("block_ix")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    df = body.withColumn("_since", F.coalesce(F.sum(F.col("is_table").cast("int")).over(past), F.lit(0)))
    title = (F.col("caption_kind") == "table") | F.col("text").rlike(r"(?iU)^\s*(продолжение|окончание)\s+табл")
    within = Window.partitionBy("doc_id", "_since").orderBy("block_ix").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("title_para_ix", F.last(F.when(title, F.col("para_ix")), ignorenulls=True).over(within)).withColumn("paragraph_before_ix", F.last("para_ix", ignorenulls=True).over(past))
    return df.where("is_table").select("doc_id", F.col("_since").cast("int").alias("table_ix"), "title_para_ix", "paragraph_before_ix")


def images_in_paragraphs(drawings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, para_ix, rid): image counts of paragraphs, and the first paragraph of each relationship."""
    return drawings.groupBy("doc_id", "para_ix").agg(F.count("*").cast("int").alias("image_count")), drawings.groupBy("doc_id", "rid").agg(F.min("para_ix").alias("para_ix"))


def table_facts(cells: DataFrame) -> DataFrame:
    """Tables from cells (doc_id, table_ix, row_ix, col_ix, cell_id, text, row_height_twips, cant_split, repeats_header, borders); merged cells count once a row."""
    once = cells.groupBy("doc_id", "table_ix", "row_ix", "cell_id").agg(F.min("col_ix").alias("col_ix"), F.min_by("text", "col_ix").alias("text"), F.max("row_height_twips").alias("h"), F.max("cant_split").alias("cs"), F.max("repeats_header").alias("rh"), F.min_by("borders", "col_ix").alias("borders"))
    rows = once.groupBy("doc_id", "table_ix", "row_ix").agg((~F.bool_or(C.not_blank("text"))).alias("empty"), (F.max("h") / 20).alias("height"), F.max("cs").alias("cs"), F.max("rh").alias("rh"), F.max("col_ix").alias("last"), F.min_by("borders", "col_ix").alias("borders"))
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("row_ix"))))
    visible = lambda b: ~F.coalesce(b["val"], F.lit("none")).isin("none", "nil")
    first = F.min_by("borders", "row_ix")
    return rows.groupBy("doc_id", "table_ix").agg(
        (F.max("row_ix") + 1).alias("rows_count"), (F.max("last") + 1).alias("columns_count"), ids(F.col("empty")).alias("empty_row_ix"), ids(F.col("height") > 30).alias("enlarged_row_ix"), F.max("cs").alias("has_cant_split_rows"), F.max("rh").alias("repeats_header"),
        F.max(F.when(F.col("row_ix") == 0, ~F.col("empty"))).alias("has_header_row"), F.when(F.size(first) > 0, F.exists(first, visible)).alias("has_grid"), F.get(F.filter(first, visible), F.lit(0))["color"].alias("border_color"), (F.get(F.filter(first, visible), F.lit(0))["size"] / 8).alias("border_size"),
    )


def section_facts(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """Sections (EMU sizes) with centimetres, format, orientation and page-number facts of their parts.

    parts: doc_id, section_ix, part (header, footer, first_header, first_footer), pos, instr, alignment, text.
    """
    has = F.upper(F.coalesce("instr", F.lit(""))).contains("PAGE")
    at = lambda p: F.col("part") == p
    facts = parts.groupBy("doc_id", "section_ix").agg(
        *(F.max(at(p) & has).alias(f"_{p}") for p in ("header", "footer", "first_header", "first_footer")), *(F.min_by("alignment", F.when(at(p) & has, F.col("pos"))).alias(f"_{p}_align") for p in ("header", "footer")),
        *(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(at(p) & C.not_blank("text"), F.struct("pos", "text")))), lambda x: C.stripped(x["text"])), "\n").alias(f"{p}_text") for p in ("header", "footer")),
    )
    df = sections.join(facts, ["doc_id", "section_ix"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    sizes = {f"{c}_cm": C.emu_to_cm(f"{c}_emu") for c in ("page_width", "page_height", "top_margin", "bottom_margin", "left_margin", "right_margin", "header_distance", "footer_distance")}
    df = df.withColumns(sizes)
    return df.withColumns(
        {
            "page_orientation": C.orientation("page_width_cm", "page_height_cm"), "page_format": C.page_format("page_width_cm", "page_height_cm"), "has_footer_page_number": no("_footer"), "has_page_number": no("_footer") | no("_header"),
            "page_number_area": F.when(no("_footer"), "footer").when(no("_header"), "header"), "page_number_alignment": F.coalesce(F.when(no("_footer"), F.col("_footer_align")), F.when(no("_header"), F.col("_header_align"))),
            "has_first_page_page_number": no("_first_header") | no("_first_footer"), "first_page_page_number_area": F.when(no("_first_footer"), "footer").when(no("_first_header"), "header"),
            "first_page_has_page_number": F.when(no("different_first_page_header_footer"), no("_first_header") | no("_first_footer")).otherwise(no("_footer") | no("_header")),
            "page_number_restart": (F.col("section_ix") > 0) & F.col("page_number_start").isNotNull(), "has_header": F.coalesce("header_text", F.lit("")) != "", "has_footer": F.coalesce("footer_text", F.lit("")) != "",
        }
    ).drop("_header", "_footer", "_first_header", "_first_footer", "_header_align", "_footer_align")


def prepared(paragraphs: DataFrame) -> DataFrame:
    """Classification, title page and logical sections in one pass of windows by document."""
    return with_logical_sections(with_title_page(classified(paragraphs)))
