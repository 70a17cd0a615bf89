"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger, a table in the shared folder, keeps the
measurements and one integer whose bit r says that rule r failed. Policies are named masks over that
integer, so a policy change or an ablation reads the ledger only, never the texts.

Defined results: a null text counts as an empty one (every measurement 0, rule few_words fails); a
null doc_id stays null; repeated rows give repeated ledger rows; an empty table gives an empty
ledger; other input columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.llm.common import from_batches, written

SYMBOLS = regex.compile(r"[#*$%&|<>]")
ODD_SPACE = regex.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclamations")
_SPACE = " \t\n\x0b\x0c\r"

#: name -> the SQL predicate under which a document fails; the position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "upper_case": "2 * n_upper_words > n_words",
    "exclamations": "10 * n_exclamations > 3 * n_words",
    "dup_lines": "100 * n_dup_lines > 70 * n_lines",
    "long_words": "word_chars > 40 * n_words",
}
#: version -> the rules that reject.
POLICIES = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "upper_case", "exclamations"),
    "v2": tuple(RULES),
}


def words_of(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+; other Unicode spaces belong to words."""
    if ODD_SPACE.search(text):
        return [w.decode() for w in text.encode().split()]
    return text.split()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, covered_to = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            total += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return total


def measure(text: str) -> tuple[int, ...]:
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(str.isupper, words)),
        text.count("!"),
    )


def measured(rows: DataFrame, out: str) -> DataFrame:
    """rows with the measurements of their column text as a struct named out; all other columns pass unread."""
    kind = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(n, pa.int64()) for n in MEASURES]
        for batch in batches:
            columns = list(zip(*(measure(x or "") for x in from_batches(batch, "text")))) or [()] * len(fields)
            found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))


def fail_bits(prefix: str = "") -> Column:
    """The ledger's integer, from columns or struct fields that hold the measurements."""
    named = lambda p: regex.sub(r"\b(n_\w+|word_chars)\b", prefix + r"\1", p)
    return sum((F.when(F.expr(named(p)), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(RULES.values())), F.lit(0)).cast("long")


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def ledger(documents: DataFrame) -> DataFrame:
    """Measurements and fail_bits of every document: the one pass over the texts."""
    rows = measured(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "_m")
    return rows.select("doc_id", "_m.*").withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds kept and policy to ledger rows."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0).withColumn("policy", F.lit(version))


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """One row for each rule of a policy: how many documents fail it, and how many only the rule itself keeps out."""
    whole = mask(POLICIES[version])
    failed = F.col("fail_bits").bitwiseAND(F.lit(whole))
    counts = rows.groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))  # 2^rules rows at most
    parts = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[version]))
    each = counts.select("failed", "n", F.explode(parts).alias("p")).where(F.col("failed").bitwiseAND(F.col("p.bit")) != 0)
    return each.groupBy(F.col("p.rule").alias("rule")).agg(
        F.sum("n").alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("p.bit"), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
    )


def judged(documents: DataFrame, version: str = "v1") -> DataFrame:
    """Ledger rows with base_failed, the verdict of the policy (base failures are never kept), and kept_without: the bit of the one rule that keeps a document out, or 0."""
    rows = apply_policy(written(ledger(documents), "quality-ledger"), version)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    out = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]) | mask(POLICIES["base"])))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", F.col("kept") & ~failed)
    return rows.withColumn("kept_without", F.when(F.bit_count(out) == 1, out).otherwise(F.lit(0)).cast("long"))


def kept_documents(documents: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that the policy and the base rules keep, with all their columns; no shuffle."""
    names = documents.columns
    plain = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]  # names with dots, or like the helper's, pass too
    rejects = mask(POLICIES[version]) | mask(POLICIES["base"])
    kept = measured(documents.toDF(*plain), "_quality").where(fail_bits("_quality.").bitwiseAND(F.lit(rejects)) == 0)
    return kept.select(*plain).toDF(*names)
