"""The scan of a collection's block tables: body, table cells and footnotes become one numbered sequence of paragraphs a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one kind that are numbered together; their totals give the rest.
CHUNK = 4096
KINDS = ("body", "table_cell", "footnote")
PLACES = ("table_ix", "row_ix", "col_ix", "note_ix")


def once_a_row(cells: DataFrame) -> DataFrame:
    """Cells without those that a merged cell repeats: of each cell_id of a row the first column stays, with all its paragraphs."""
    first = cells.groupBy("doc_id", "table_ix", "row_ix", "cell_id").agg(F.min("col_ix").alias("col_ix"))
    return cells.join(first, ["doc_id", "table_ix", "row_ix", "cell_id", "col_ix"], "left_semi")


def scanned(body: DataFrame, cells: DataFrame, footnotes: DataFrame, documents: list | None = None) -> DataFrame:
    """doc_id, para_ix, kind, text and places: body paragraphs by pos, then cells by table, row, column and pos, then footnotes by note and pos.

    documents: only these; the condition reaches the scans of all three tables. Numbers are made in two levels: rows are
    numbered inside chunks (of a table, or of CHUNK places), and the chunks of a document are summed up, so no task needs a whole
    document. Rows without doc_id are left out; of equal places the order is that of their texts.
    """
    none = F.lit(None).cast("int")

    def part(df: DataFrame, kind: int, chunk: Column, order: tuple[str, ...]) -> DataFrame:
        df = df.where(F.col("doc_id").isNotNull() if documents is None else F.col("doc_id").isin(documents))
        places = {p: F.col(p).cast("int") if p in order else none for p in PLACES}
        sort = F.struct(*(F.coalesce(F.col(c).cast("long") if c in order else F.lit(None).cast("long"), F.lit(0)).alias(c) for c in ("row_ix", "col_ix", "note_ix", "pos")), "text")
        return df.select("doc_id", F.lit(kind).alias("_kind"), chunk.cast("long").alias("_chunk"), sort.alias("_sort"), "text", *(c.alias(p) for p, c in places.items()))

    parts = (
        part(body, 0, F.floor(F.col("pos") / CHUNK), ("pos",)),
        part(once_a_row(cells), 1, F.col("table_ix"), ("table_ix", "row_ix", "col_ix", "pos")),
        part(footnotes, 2, F.floor(F.col("note_ix") / CHUNK), ("note_ix", "pos")),
    )
    rows = reduce(DataFrame.unionByName, parts)
    chunk = ["doc_id", "_kind", "_chunk"]
    inner = rows.withColumn("_inner", F.row_number().over(Window.partitionBy(*chunk).orderBy("_sort")) - 1)
    before = Window.partitionBy("doc_id").orderBy("_kind", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*chunk).agg(F.count("*").alias("_n")).select(*chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    kinds = F.array(*map(F.lit, KINDS))
    return inner.join(bases, chunk).select("doc_id", (F.col("_base") + F.col("_inner")).cast("int").alias("para_ix"), F.get(kinds, F.col("_kind")).alias("kind"), "text", *PLACES)
