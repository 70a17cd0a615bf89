"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most two bits
agree in at least one segment, and differ in at most two bits in the next one. The next segment is
padded to 23 bits and decoded with the perfect Golay code, together with each of its one-bit
neighbours: two words at distance two have a neighbour in common, hence also a codeword. So the
keys (segment, its bits, a codeword index of the next segment) of any linked pair meet. Pairs that
share a key are verified on all 64 bits.

Fingerprints are made distinct first, so copies cost nothing here. Buckets of up to BUCKET
fingerprints are joined pair by pair. The members of larger buckets are linked exactly, without
pairs: each is sent to the 65 words at distance one or less from it. Two fingerprints at distance
two or less meet in such a word, and all that meet in a word are at distance two or less from each
other, so a star on the smallest of them loses no link.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; texts of
fewer than three words are hashed whole; a null doc_id keeps its row and never becomes a
component_id unless all of its component are null; repeated rows are repeated in the result; an
empty table gives an empty result; input columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.common import from_batches, written
from quillcheck.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
BUCKET = 32
_SLAB = 1 << 16

#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE].tolist()
    spans = list(zip(starts, ends[SHINGLE - 1 :].tolist()))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), _SLAB):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + _SLAB]], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # so that bytes can hold the sums
            ones += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x or "") for x in from_batches(batch, "text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


_decoder: list[np.ndarray] = []


def codeword_index() -> np.ndarray:
    """For every 23-bit word the 12 message bits of its nearest codeword; made once in each worker."""
    if not _decoder:
        words = np.arange(1 << 23, dtype=np.uint32)
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY << (bit - 11))
        error = np.zeros(1 << 11, np.uint32)  # by remainder: the only pattern of three bits or fewer
        singles = [1 << i for i in range(23)]
        patterns = [0, *singles, *(a | b for a in singles for b in singles if a < b), *(a | b | c for a in singles for b in singles if a < b for c in singles if b < c)]
        error[rest[patterns]] = patterns
        _decoder.append(((words ^ error[rest]) >> np.uint32(11)).astype(np.uint16))
    return _decoder[0]


def neighbours(width: int) -> np.ndarray:
    """Masks of no bit and of each single bit of a segment."""
    return np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return ((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def key(family: int, exact: np.ndarray, index: np.ndarray) -> np.ndarray:
    return np.int64(family) << np.int64(40) | exact.astype(np.int64) << np.int64(12) | index.astype(np.int64)


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key), each pair once."""
    decoded, at, keys = codeword_index(), [], []
    for k in range(len(SEGMENTS)):
        nxt = (k + 1) % len(SEGMENTS)
        near = np.sort(decoded[segment(fp, nxt)[:, None] ^ neighbours(SEGMENTS[nxt][1])], axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        at.append(row)
        keys.append(key(k, segment(fp, k)[row], near[row, col]))
    return np.concatenate(at), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        for part in range(0, len(signed), 4096):
            row, keys = bucket_keys(signed[part : part + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(signed[part + row])], names=["key", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the 64 bits as a signed long."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _words_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        for part in range(0, len(signed), 4096):
            fp = signed[part : part + 4096]
            words = (fp.view(np.uint64)[:, None] ^ flips).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.repeat(fp, 65))], names=["word", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp); linked ones are always connected by edges."""
    keyed = written(distinct.select("fp").mapInArrow(_keyed, "key long, fp long"), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key"), "simhash-shared")
    small, large = shared.where(F.col("n") <= BUCKET), shared.where(F.col("n") > BUCKET)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    near = large.select("fp").distinct().mapInArrow(_words_near, "word long, fp long")
    roots = near.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    stars = near.join(roots, "word").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    rows = written(fingerprints(documents), "simhash-fp")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(distinct))  # node, root: only for fingerprints that have links
    label = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    smallest = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(label.join(smallest, "root").select("fp", "component_id"), "fp")


def hex16(column: str) -> "F.Column":
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def first_of_group(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with its smallest doc_id. Rows without doc_id, and repeated rows of a doc_id that stays, stay."""
    gone = near_duplicates(documents).where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
