"""Tables of ordered text blocks: adapters, and sources and sinks of rules, candidates and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


RULE_FIELDS = T.StructType().add("id", "string", False).add("category", "string").add("target", "string").add("parameter", "string", False).add("operator", "string").add("value", "variant").add("unit", "string").add("modality", "string").add("origin", "string").add("description", "string").add("source_text", "string").add("source_section", "string").add("consistency_strategy", "variant").add("condition", "variant").add("relative_to", "variant").add("enabled", "boolean")
PROFILE = T.StructType().add("id", "string", False).add("name", "string").add("rules", T.ArrayType(RULE_FIELDS))
CATEGORIES = ("formatting", "structure", "text", "consistency", "linguistic")
MODALITIES = ("mandatory", "recommended", "allowed")
OPERATORS = ("equals", "min", "max", "in", "consistent", "contains", "matches", "required", "not_contains")


def paragraphs_of_documents(documents: DataFrame) -> DataFrame:
    """doc_id, para_ix, text: the lines of each text."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_ix", "text"))


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """doc_id, para_ix, tag, text, style_name of headings, paragraphs and list items of HTML pages."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>"), F.lit(0))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("para_ix", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"(?is)^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    style = F.when(tag.rlike("^h[1-6]$"), F.concat(F.lit("Heading "), F.substring(tag, 2, 1))).when(tag == "li", "List Paragraph").otherwise("Normal")
    return rows.select("doc_id", "para_ix", tag.alias("tag"), text.alias("text"), style.alias("style_name"))


def blocks_of_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para_ix"), F.col("role").alias("style_name"), "text")


def styled_of_lineitem(lineitem: DataFrame) -> DataFrame:
    """Order lines as styled paragraphs: numeric columns stand for measured attributes."""
    return lineitem.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("para_ix"),
        F.lit("main_text").alias("paragraph_type"),
        (F.floor(F.col("l_quantity") / 10) + 10).cast("double").alias("font_size_pt"),
        F.when(F.col("l_returnflag") == "N", "justify").when(F.col("l_returnflag") == "A", "left").otherwise("center").alias("alignment"),
        (F.col("l_tax") * 25).alias("first_line_indent_cm"),
        (1 + F.round(F.col("l_discount") * 10) / 10).alias("line_spacing"),
        (F.col("l_linestatus") == "F").alias("bold"),
        F.col("l_suppkey").cast("string").alias("font_family"),
    )


def typed_values(rules: DataFrame) -> DataFrame:
    """Adds value_num, value_str, value_bool and value_list to rules with a variant value."""
    kind = F.schema_of_variant("value")
    return rules.withColumns(
        {
            "value_bool": F.when(kind == "BOOLEAN", F.expr("try_variant_get(value, '$', 'boolean')")),
            "value_num": F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.expr("try_variant_get(value, '$', 'double')")),
            "value_str": F.when(kind == "STRING", F.expr("try_variant_get(value, '$', 'string')")),
            "value_list": F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(value, '$', 'array<string>')")),
        }
    )


_HIGH = bytes(range(128, 256))
#: The characters that bytes from 128 on stand for, in Latin-1 and in the Cyrillic code page of old profiles (one byte of it stands for nothing).
LATIN, CYRILLIC = _HIGH.decode("latin-1"), _HIGH.decode("cp1251", "replace")


def decoded(content: Column | str) -> Column:
    """Text of bytes: UTF-8, with or without a byte order mark, or else windows-1251."""
    raw = F.col(content) if isinstance(content, str) else content
    old = F.translate(F.decode(raw, "ISO-8859-1"), LATIN, CYRILLIC)
    return F.regexp_replace(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(old), "^\ufeff", "")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON profiles, one row a rule with its place (ordinal)."""
    files = spark.read.format("binaryFile").load(path).select(F.from_json(decoded("content"), T.ArrayType(PROFILE)).alias("profiles"))
    read = files.select(F.explode("profiles").alias("p")).select("p.*").where("id is not null")
    rows = read.select(F.col("id").alias("profile_id"), F.posexplode("rules").alias("ordinal", "rule"))
    rules = rows.select("profile_id", "ordinal", F.col("rule.id").alias("rule_id"), *(f"rule.{f.name}" for f in RULE_FIELDS if f.name not in ("id", "enabled")), F.coalesce("rule.enabled", F.lit(True)).alias("enabled"))
    return typed_values(rules)


def rule_faults(rules: DataFrame) -> DataFrame:
    """Rules that cannot be used, with the reason; a valid profile has none."""
    reason = (
        F.when(F.col("rule_id").isNull() | F.col("parameter").isNull(), "id or parameter missing")
        .when(~F.col("category").isin(*CATEGORIES), "unknown category")
        .when(~F.col("modality").isin(*MODALITIES), "unknown modality")
        .when(~F.col("operator").isin(*OPERATORS), "unknown operator")
        .when(F.col("operator").isin("min", "max") & F.col("value_num").isNull(), "limit is no number")
        .when((F.col("operator") == "in") & F.col("value_list").isNull(), "list missing")
    )
    return rules.withColumn("fault", reason).where("fault is not null")


SUMMARY = ("doc_id", "rule_id", "parameter", "location", "paragraph_index", "expected", "actual", "message", "severity", "violation_type")


def write_summary(violations: DataFrame, path: str, run: str | None = None) -> None:
    """Findings as JSON, one a line: a new path, or the folder of a run, which a repeated run replaces."""
    rows = violations.select(*SUMMARY)
    if run is None:
        rows.write.mode("errorifexists").json(path)
    else:
        rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


MANIFEST = "_manifest"


def save_candidates(candidates: DataFrame, path: str) -> None:
    """candidates with a column extraction_id, one folder for each; an extraction that is saved again replaces its rows.

    Its line in the manifest, with the number of its rows, is written last: what has no line was never finished.
    """
    replace = {"partitionOverwriteMode": "dynamic"}
    candidates.write.mode("overwrite").options(**replace).partitionBy("extraction_id").parquet(path)
    ids = candidates.select(F.col("extraction_id").alias("_id")).distinct()
    stored = candidates.sparkSession.read.schema(candidates.schema).parquet(path).join(F.broadcast(ids), F.col("extraction_id") == F.col("_id"), "left_semi")  # the extractions of one save
    lines = stored.groupBy("extraction_id").agg(F.count("*").alias("n_rows"), F.current_timestamp().alias("saved_at"))
    lines.write.mode("overwrite").options(**replace).partitionBy("extraction_id").parquet(f"{path}/{MANIFEST}")


def saved_extractions(spark: SparkSession, path: str) -> DataFrame:
    """extraction_id, n_rows and saved_at of all that is complete."""
    return spark.read.schema("n_rows long, saved_at timestamp, extraction_id string").parquet(f"{path}/{MANIFEST}")


def load_candidates(spark: SparkSession, path: str, extraction_id: str) -> DataFrame:
    """The candidates of one extraction; only its folder is read."""
    if saved_extractions(spark, path).where(F.col("extraction_id") == extraction_id).isEmpty():
        raise ValueError(f"extraction {extraction_id} was not saved whole")
    return spark.read.parquet(path).where(F.col("extraction_id") == extraction_id)


def profile_documents(rules: DataFrame) -> DataFrame:
    """One row for each profile: profile_id and its JSON text, rules in order."""
    rule = F.struct(F.col("rule_id").alias("id"), "category", "target", "parameter", "operator", "value", "unit", "modality", "source_section")
    rows = rules.select("profile_id", F.struct("ordinal", F.to_json(rule).alias("json")).alias("r"))
    lists = rows.groupBy("profile_id").agg(F.sort_array(F.collect_list("r")).alias("r"))  # the rules of one profile
    head = F.regexp_extract(F.to_json(F.struct(F.col("profile_id").alias("id"))), r"(?s)^(.*)\}$", 1)
    return lists.select("profile_id", F.concat(head, F.lit(',"rules":['), F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit("]}")).alias("profile_json"))


def write_profiles(rules: DataFrame, path: str) -> None:
    """Profiles as JSON, one a line, each in a folder of its own, which the same profile replaces when it is written again."""
    profile_documents(rules).select("profile_json", "profile_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_id").text(path)


def grouped_json(violations: DataFrame) -> DataFrame:
    """One row for each document: its findings as JSON, by section, then by rule."""
    finding = F.struct("paragraph_index", "location", "expected", "actual", "message", "severity")
    rules = violations.groupBy("doc_id", "source_section", "rule_id").agg(F.sort_array(F.collect_list(finding)).alias("violations"))
    sections = rules.groupBy("doc_id", "source_section").agg(F.sort_array(F.collect_list(F.struct("rule_id", "violations"))).alias("rules"))
    return sections.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("source_section", "rules")))).alias("report_json"))
