"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing; each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.llm import mixing, near_copies, packing, pii, quality_rules
from quillcheck.llm.common import table, written
from quillcheck.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go. A null text counts as empty and goes; repeated rows and rows without doc_id are judged each; an empty table stays empty; all columns pass."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.

    Candidates by bands of least values, since at this similarity SimHash keys meet too rarely. Null and empty texts are copies of each other; rows without doc_id, and repeated rows of a
    doc_id that stays, stay; an empty table stays empty; all columns pass.
    """
    return near_copies.first_of_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the new text. A null text stays null; every row stays, whatever its doc_id; an empty table stays empty; all columns pass."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the mix of sources. Rows without source are a source of their own, those without doc_id come first in theirs; repeated rows stand next to each other; an empty table stays empty; all columns pass."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens that follow the mix. A null text is its end alone; repeated rows and rows without doc_id are packed each; an empty table gives no pieces."""
    return packing.pack_in_order(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("pii_redaction", personal_data),
    ("pfair_mixing", mixed),
    ("best_fit_packing", packed),
]

#: SQL cannot run the tokenizer and the packing of the last stage; tests/llm holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
