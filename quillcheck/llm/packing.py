"""Best-two-fit packing of tokenised documents into sequences.

Only lengths decide a packing, and a piece has 1 to SIZE tokens. So the counts of pieces by length
(SIZE numbers, whatever the corpus) are packed: a sequence is filled greedily with the longest
pieces that fit; then its smallest piece gives way to two unpacked pieces that fill the grown gap
more tightly, if there are such; the result is a pattern, used as often as the counts allow. Each
pattern uses up a length, but for a remainder smaller than its own use of it, which bounds the
number of patterns independently of the corpus.

The pieces then find their places by their rank among the pieces of equal length, which is counted
by block, without a shuffle of the pieces: block counts are summed up, and a piece's rank is its
rank in its block plus the pieces of its length in the blocks before.

pack_in_order packs inside consecutive windows of the documents' order instead, so that an order such
as a mix of sources reaches the sequences: pieces are numbered by the files they are read from and
their rows there, a window has about WINDOW tokens, and sequences follow each other by window and inside
it by the mean place of their pieces. All pieces of a window are packed there, so a window may end with a
sequence that is not full.

Defined results: a null text is an empty one (one piece, the end id); a null doc_id stays null;
repeated rows are packed each; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.llm.common import prefix_sum, written
from quillcheck.llm.token_ids import encoded

END_ID, SIZE = 1, 4096
#: Tokens of a window.
WINDOW = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, in_block long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Pieces of at most size tokens; in_block is a piece's rank among those of its length in its block (a task)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, block, seen = np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        kinds, rows = [pa.int64(), pa.int32(), *[pa.int64()] * 5], []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=_names(PIECES))
        for doc_id, ids in encoded(batches, tokenizer, False):
            whole = memoryview(ids + end)
            for k, at in enumerate(range(0, len(whole), 4 * size)):
                part = whole[at : at + 4 * size]
                n = len(part) // 4
                rows.append((doc_id, k, at // 4, n, zlib.crc32(part), block, int(seen[n])))
                seen[n] += 1
            if len(rows) >= 10_000:
                yield table()
                rows = []
        yield table()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """Patterns [(how often, {length: pieces in each sequence})] that use up the counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(size + 1)
    patterns = []
    while left.any():
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest piece left of at most that length
        used: dict[int, int] = {}
        gap = size
        while gap and (best := int(fits[gap])):
            n = int(min(gap // best, left[best]))
            used[best] = used.get(best, 0) + n
            gap -= n * best
            if n == left[best]:  # none remains for this sequence
                fits = np.where(fits == best, fits[best - 1], fits)
        if gap:
            _swap(used, gap, left, lengths)
        often = int(min(left[x] // n for x, n in used.items()))
        for x, n in used.items():
            left[x] -= often * n
        patterns.append((often, used))
    return patterns


def _swap(used: dict[int, int], gap: int, left: np.ndarray, lengths: np.ndarray) -> None:
    """Replaces the smallest piece of a sequence by the two unpacked pieces that fill its place and the gap best, if they fill more."""
    free = left.copy()
    for x, n in used.items():
        free[x] -= n
    small = min(used)
    room = small + gap
    fits = np.maximum.accumulate(np.where(free > 0, lengths, 0))
    first = np.flatnonzero(free[:room] > 0)
    second = fits[np.minimum(room - first, first)]  # the second is not longer than the first
    alone = (second == first) & (free[first] < 2)
    second = np.where(alone, fits[np.maximum(first - 1, 0)], second)
    sums = np.where(second > 0, first + second, 0)
    if len(sums) and sums.max() > small:
        k = int(sums.argmax())
        used[small] -= 1
        if not used[small]:
            del used[small]
        for x in (int(first[k]), int(second[k])):
            used[x] = used.get(x, 0) + 1


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset, pieces in each sequence), ascending by rank."""
    found: dict[int, list[tuple[int, ...]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for often, used in patterns:
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            found.setdefault(x, []).append((ranks.get(x, 0), sequence, offset, n))
            ranks[x] = ranks.get(x, 0) + often * n
            offset += n * x
        sequence += often
    return {x: np.array(rows, np.int64) for x, rows in found.items()}


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """One row for each piece with its sequence_id and its offset there."""
    cut = written(pieces(documents, tokenizer, size), "pieces")
    by_block = written(cut.groupBy("block", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    places = slots(best_two_fit(counts, size))
    before = prefix_sum(by_block, "block", "n", "before", within=("length",)).select("block", "length", "before")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at, table = np.flatnonzero(length == x), places[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + k // row[:, 3], row[:, 2] + k % row[:, 3] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=_names(PLACED))

    before = before.hint("merge")  # it grows with the number of blocks, so it is never broadcast
    ranked = cut.join(before, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("in_block") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(placed, PLACED)


def _ordered(documents: DataFrame) -> DataFrame:
    """documents with _file and _at: the file and the row in it that a row is read from, or else its partition and its row there."""
    try:
        meta = documents.metadataColumn("_metadata")
        return documents.withColumn("_file", meta["file_name"]).withColumn("_at", meta["row_index"])
    except AnalysisException:  # not read from files
        return documents.withColumn("_file", F.concat(F.lit("part-"), F.spark_partition_id().cast("string"))).withColumn("_at", F.monotonically_increasing_id())


def _file_order(name: str) -> tuple[int, str]:
    """Spark numbers the files of an ordered table; the numbers may differ in length."""
    number = re.match(r"part-(\d+)", name)
    return int(number[1]) if number else -1, name


def pack_in_order(documents: DataFrame, tokenizer: str, size: int = SIZE, window: int = WINDOW) -> DataFrame:
    """As pack, but sequence_id follows the order of the documents in their files, by windows."""
    spark = documents.sparkSession
    cut_schema = "doc_id long, file string, at long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, rows = np.array([END_ID], "<u4").tobytes(), []
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=_names(cut_schema))
        for key, ids in encoded(batches, tokenizer, False):
            whole = memoryview(ids + end)
            for k, at in enumerate(range(0, len(whole), 4 * size)):
                part = whole[at : at + 4 * size]
                rows.append((key["id"], key["file"], key["at"], k, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= 10_000:
                yield table()
                rows = []
        yield table()

    keyed = _ordered(documents.select("doc_id", "text")).select(F.struct(F.col("doc_id").cast("long").alias("id"), F.col("_file").alias("file"), F.col("_at").alias("at")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(keyed.mapInArrow(cut, cut_schema), "ordered-pieces")
    totals = found.groupBy("file").agg(F.sum("length").alias("n")).collect()  # one row a file
    files, before = [], 0
    for r in sorted(totals, key=lambda r: _file_order(r["file"])):
        files.append((r["file"], before))
        before += r["n"]
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("at", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.withColumn("_inside", inside).join(F.broadcast(spark.createDataFrame(files, "file string, _before long")), "file").withColumn("place", F.col("_inside") + F.col("_before"))
    numbered = numbered.select(F.expr(f"place div {window}").alias("window"), "place", *_names(PLACED)[:5])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        length, place = table["length"].to_numpy(), table["place"].to_numpy()
        sizes, counts = np.unique(length, return_counts=True)
        places = slots(best_two_fit(dict(zip(sizes.tolist(), counts.tolist())), size))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in sizes.tolist():
            at, by_rank = np.flatnonzero(length == x), places[x]
            row = by_rank[np.searchsorted(by_rank[:, 0], np.arange(len(at)), "right") - 1]
            k = np.arange(len(at)) - row[:, 0]
            sequence[at], offset[at] = row[:, 1] + k // row[:, 3], row[:, 2] + k % row[:, 3] * x
        mean = np.bincount(sequence, weights=(place - place[0]) * length) / np.bincount(sequence, weights=length)
        rank = np.empty(len(mean), np.int64)
        rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
        columns = [table["window"], *(table[c] for c in _names(PLACED)[:5]), pa.array(rank[sequence]), pa.array(offset)]
        return pa.table(columns, names=["window", *_names(PLACED)])

    inner = written(numbered.groupBy("window").applyInArrow(packed, f"window long, {PLACED}"), "packed-windows")
    sequences = inner.groupBy("window").agg((F.max("sequence_id") + 1).alias("n"))
    first = prefix_sum(sequences, "window", "n", "_first").select("window", "_first")
    return inner.join(first, "window").withColumn("sequence_id", F.col("sequence_id") + F.col("_first")).select(*_names(PLACED))
