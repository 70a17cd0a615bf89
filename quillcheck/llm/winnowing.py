"""Document fingerprints by winnowing.

Rolling hashes of all runs of K code points are taken; of each window of W consecutive hashes the
least is kept, the rightmost where it occurs more than once, with its position. So two texts that
share any stretch of K + W - 1 code points share a kept hash, and no shared stretch of fewer than K is
ever reported. Running sums of code points times powers of an odd base give each hash in two steps,
whatever K is.

Defined results: a null text is an empty one and has no hashes; a text of fewer than K code points
has one hash, of all of it, and one of fewer than W hashes is one window; equal texts have equal
fingerprints; two empty fingerprints are alike (1.0). Documents follow each other by falling doc_id,
those of one doc_id and those without (last) by a hash of their text; after the last comes the first,
which for a single document is itself. An empty table gives an empty result; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.llm.common import from_batches, written

#: Code points of a hashed run, and hashes of a window: stretches of 47 code points are always found.
K, W = 16, 32
#: Ranges of documents for each partition of a shuffle.
RANGES = 4

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as any text has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 12)
            series = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
            self.up, self.down = series(_BASE), series(_INVERSE)


_powers = Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def rolling(codes: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of each run of k code points, or of the whole where it is shorter."""
    n = len(codes)
    width = min(k, n)
    if not width:
        return np.empty(0, np.uint64)
    _powers.reach(n + 1)
    sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers.down[:n], dtype=np.uint64)
    runs = sums[width - 1 :].copy()
    runs[1:] -= sums[:-width]
    return _mixed(runs * _powers.up[: n - width + 1])


def rightmost_minima(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the least hash of each window of w, the rightmost among equal ones, each once, ascending."""
    if not len(hashes):
        return np.empty(0, np.int64)
    w = min(w, len(hashes))
    least, at, reach = hashes, np.arange(len(hashes)), 1
    while reach < w:  # windows of reach become windows of reach + step
        step = min(reach, w - reach)
        right = least[step:] <= least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        reach += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnowed(codes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(kept hashes, their positions), by position."""
    hashes = rolling(codes, k)
    at = rightmost_minima(hashes, w)
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes."""
    a, b = np.unique(a), np.unique(b)
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def fingerprints(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes (unsigned, as longs) and positions (code points) of each document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnowed(code_points(x or ""), k, w) for x in from_batches(batch, "text")]
            ends = pa.array(np.cumsum([0, *(len(at) for _, at in found)]), pa.int32())
            flat = [np.concatenate([np.empty(0, np.uint64), *(h for h, _ in found)]).view(np.int64), np.concatenate([np.empty(0, np.int64), *(at for _, at in found)]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)], names=["doc_id", "hashes", "positions"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, hashes array<long>, positions array<int>")


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """hash@position, comma-joined; hashes in hexadecimal."""
    return ",".join(map("%016x@%d".__mod__, zip(hashes.tolist(), positions.tolist())))


def in_ranges(documents: DataFrame) -> DataFrame:
    """doc_id and text with part, the number of a range in the order of documents, and the keys of that order: absent, low (falling doc_id), tie.

    Ranges are cut at quantiles of a sketch of doc_id; documents without one are cut by the hash that orders them.
    """
    spark = documents.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("*", F.col("doc_id").isNull().alias("absent"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("low"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    shares = [i / n for i in range(1, n)]
    cuts = keyed.where("not absent").agg(F.percentile_approx("low", shares, 10 * n)).first()[0] or []
    splits = [-float("inf"), *sorted(set(map(float, cuts))), float("inf")]  # n numbers; equal ones would be empty ranges
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="_low", outputCol="_part").transform(keyed.withColumn("_low", F.col("low").cast("double")))
    else:
        keyed = keyed.withColumn("_part", F.lit(0.0))
    of_tie = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1))
    return keyed.withColumn("part", F.when(F.col("absent"), F.lit(len(splits)) + of_tie).otherwise(F.col("_part").cast("long"))).drop("_low", "_part")


def with_guests(ranged: DataFrame) -> DataFrame:
    """ranged with guest: each range also gets, as a guest after its own documents, the first document of the next range (the last range: of the first)."""
    heads = ranged.groupBy("part").agg(F.min(F.struct("absent", "low", "tie")).alias("head"))
    order = Window.orderBy("part")  # one row a range, without its text
    first = F.first("head").over(order)
    following = written(heads.select("part", F.coalesce(F.lead("head").over(order), first).alias("head")).select("part", "head.*"), "range-heads")
    texts = ranged.drop("part").join(following, ["absent", "low", "tie"]).dropDuplicates(["part"])
    return ranged.withColumn("guest", F.lit(False)).unionByName(texts.withColumn("guest", F.lit(True)))


def edited_likeness(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    The edited text: the last half of a text's code points (rounded down) gives way to as many first ones of the next document.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows, size, last = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], [], 0, None
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)
        for batch in batches:
            for doc_id, text, guest in zip(from_batches(batch, "doc_id"), from_batches(batch, "text"), from_batches(batch, "guest")):
                text = text or ""
                codes = code_points(text)
                found = winnowed(codes, k, w)
                if last is not None:
                    own_id, own, own_codes, own_found = last
                    half = len(own) // 2
                    edited = winnowed(np.concatenate([own_codes[: len(own) - half], codes[:half]]), k, w)
                    digest = hashlib.sha256((own[: len(own) - half] + text[:half]).encode()).hexdigest()
                    rows.append((own_id, len(own), digest, as_text(*own_found), as_text(*edited), likeness(own_found[0], edited[0]), likeness(own_found[0], found[0])))
                    size += len(rows[-1][3]) + len(rows[-1][4])
                last = None if guest else (doc_id, text, codes, found)
                if size > 1 << 22:
                    yield table()
                    rows, size = [], 0
        yield table()

    rows = with_guests(in_ranges(documents)).repartition("part").sortWithinPartitions("part", "guest", "absent", "low", "tie")
    return rows.select("doc_id", "text", "guest").mapInArrow(made, schema)
