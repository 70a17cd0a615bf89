"""Importance resampling towards a target text collection, with hashed n-gram features.

A text's features are its runs of 1 to LONGEST words; a feature's bucket is the crc32 of its bytes
modulo BUCKETS. Bucket counts of both collections give each bucket a gain (a log ratio in
thousandths), an array of BUCKETS numbers that goes to every task; a text's weight is the sum over its
features, and Gumbel noise from its doc_id makes the weight a score, so that the highest scores are a
draw without replacement.

The cutoff between drawn and other documents is found without sorting them: a quantile sketch of the
scores brackets it, exact counts above and inside the bracket show whether it does (else the bracket
is widened), and only the bracket is sorted. All counts are over all documents.

Defined results: a null text has no words; a null doc_id counts as an empty one in the noise and
comes last among equal scores; repeated rows are documents each, and where they tie in score and
doc_id the lower ranks go to any of them; documents of fewer than MIN_WORDS words are scored but never
drawn; empty tables give no rows, or gains from the other table alone; columns other than doc_id and
text (texts of the target: the column that is named) are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.llm.common import written

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
MIN_WORDS, PERCENT = 20, 10
#: Relative accuracy of the sketch; a bracket reaches two steps of it to either side.
ACCURACY = 10_000
#: Bytes of texts that are taken apart at once, and the longest word whose sum is taken together with others'.
SLAB, LONG_WORD = 1 << 22, 64

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    """What one byte does to a crc32 with the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of data, carried on from the sums before."""
    order = np.argsort(-sizes, kind="stable")
    long = int((sizes > LONG_WORD).sum())
    out = np.empty(len(starts), np.uint32)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], int(before[i]))
    order = order[long:]
    at, ends, state = starts[order], -sizes[order], ~before[order]
    for k in range(int(-ends[0]) if len(ends) else 0):
        n = int(np.searchsorted(ends, -k))  # stretches of more than k bytes stand first
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def features(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words in each row, row and bucket of each feature), by slabs of rows."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, "right")) - 1)
        edges = offsets[row : end + 1] - offsets[row]
        part = _LOWER[data[offsets[row] : offsets[end]]]
        inside = _IN_WORD[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(part))]  # a word ends where its text does
        first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        of = np.searchsorted(edges, starts, "right") - 1
        sums = crc_of(part, starts, sizes, np.zeros(len(starts), np.uint32))
        rows, found = [of], [sums % buckets]
        for n in range(2, longest + 1):
            runs = max(0, len(of) - n + 1)
            same = np.flatnonzero(of[n - 1 :] == of[:runs])
            spaced = ~(_CRC[(~sums[same] ^ 32) & 255] ^ (~sums[same] >> 8))
            sums = np.zeros(runs, np.uint32)
            sums[same] = crc_of(part, starts[same + n - 1], sizes[same + n - 1], spaced)
            rows.append(of[same])
            found.append(sums[same] % buckets)
        yield row, end, np.bincount(of, minlength=end - row), np.concatenate(rows), np.concatenate(found)
        row = end


def bucket_counts(texts: DataFrame, column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has some."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features(batch.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(column).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the bucket counts of both collections: so many numbers, whatever their size."""
    both = raw.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    counts = np.zeros((2, buckets))
    for r in both.collect():  # one row a bucket
        counts[:, r["bucket"]] = r["s"] or 0, r["t"] or 0
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return [math.floor(1000 * math.log(r)) for r in ratio.tolist()]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(documents: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    table = np.array(gain, np.float64)  # sums stay exact below 2^53

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words, rows, found in features(batch.column(1), longest, len(table)):
                n = np.bincount(rows, minlength=end - row)
                weight = np.bincount(rows, weights=table[found], minlength=end - row).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(scored: DataFrame) -> DataFrame:
    """scored with rank (from 1), by falling score, then by doc_id: sorted by ranges; a range's base is the sum of those before it (one row a range)."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(bases, "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def bracket(scored: DataFrame, rank: int, rows: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the score of the given rank lies between low and high, and so many rows are above high.

    The sketch proposes, exact counts decide: a bracket that misses the rank is widened, in the end to all scores.
    """
    step = 2 / accuracy
    while True:
        share = 1 - rank / rows
        low, high = max(0.0, share - step), min(1.0, share + step)
        sketch = scored.agg(F.percentile_approx("score", F.array(F.lit(low), F.lit(high)), accuracy).alias("q"), F.min("score").alias("least"), F.max("score").alias("most")).first()
        a, b = sketch["least"] if low == 0 else sketch["q"][0], sketch["most"] if high == 1 else sketch["q"][1]
        counts = scored.agg(F.count_if(F.col("score") > b).alias("above"), F.count_if(F.col("score").between(a, b)).alias("inside")).first()
        if counts["above"] < rank <= counts["above"] + counts["inside"]:
            return a, b, counts["above"]
        step *= 4


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """scored (a written table) with rank: 1, 2, 3, ... in the order of the draw, null where a document is not drawn."""
    fit = scored.where(F.col("n_words") >= min_words)
    rows = fit.count()
    k = percent * rows // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select("*", none)
    low, high, above = bracket(fit, k, rows, accuracy)
    cut = ranked(fit.where(F.col("score").between(low, high)).select("score", "doc_id")).where(F.col("rank") == k - above).first()
    reached = (F.col("n_words") >= min_words) & (F.col("score") >= cut["score"])
    if cut["doc_id"] is not None:  # rows without doc_id come last among equal scores
        reached &= (F.col("score") > cut["score"]) | F.coalesce(F.col("doc_id") <= cut["doc_id"], F.lit(False))
    order = ranked(scored.where(reached))  # rows that tie with the last one in score and doc_id may go beyond it
    return order.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(scored.where(~reached).select("*", none))


def resampled(documents: DataFrame, target: DataFrame, target_column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score and, where it is drawn, rank."""
    gain = gains(bucket_counts(documents, "text", longest, buckets), bucket_counts(target, target_column, longest, buckets), buckets)
    return drawn(written(scores(documents, gain, longest, seed), "importance-scores"), percent, min_words)
