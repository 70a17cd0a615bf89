"""Token-id shards under Re-Pair grammars, with random-access decoding.

The texts are dealt by ranges of doc_id, encoded in ascending doc_id order and cut into shards of
about SHARD_TOKENS ids. In each shard pairs of neighbouring symbols are replaced by new symbols, the
most frequent first, until no pair occurs MIN_COUNT times. Pairs are replaced by rounds: where two
frequent pairs share a symbol, the more frequent one gets it, and a pair that is left with fewer than
MIN_COUNT places waits for the next round's counts, as it would wait for its turn one by one. After a
round only pairs next to new symbols, and those that waited, can be frequent, so only their places are
counted again. One record holds a shard:

    doc_ids, doc_tokens   int64 (null_ids: positions of null doc_ids) and uint32 arrays, one entry a document
    base                  first nonterminal; smaller symbols are token ids
    rules                 uint32 pairs: symbol base + i stands for rules[i]
    rounds                uint32: how many rules each round added
    lengths               uint32: tokens that each rule expands to
    sequence              uint32: the compressed shard

so a reader finds any token range from the running sum of expansion lengths and expands only the
symbols that cover it. The records are rows of a Parquet table in the shared folder.

Defined results: a null text is an empty one and has the end id only; documents without doc_id come
first; rows with equal doc_id stand next to each other in no particular order; an empty table gives
no shard; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.common import prefix_sum, written
from quillcheck.llm.token_ids import encoded

END_ID = 2
SHARD_TOKENS = 1 << 20
#: A pair becomes a rule from this count on. A rule takes three words (its pair and its length) and saves one at each place.
MIN_COUNT = 4

SHARDS = "shard long, n_docs long, n_tokens long, base int, doc_ids binary, null_ids binary, doc_tokens binary, rules binary, rounds binary, lengths binary, sequence binary"
DECODED = "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def _winners(places: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which of the pairs that begin at places (ascending) are replaced, if the higher of two that share a symbol goes first."""
    taken, open_ = np.zeros(len(places), bool), np.arange(len(places))
    while len(open_):
        at, p = places[open_], priority[open_]
        near = np.diff(at) == 1
        best = np.ones(len(at), bool)
        best[1:] &= ~near | (p[1:] > p[:-1])
        best[:-1] &= ~near | (p[:-1] > p[1:])
        taken[open_[best]] = True
        gone = best.copy()
        gone[1:] |= near & best[:-1]
        gone[:-1] |= near & best[1:]
        open_ = open_[~gone]
    return taken


def _without_overlaps(pairs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places stay, if each second one goes in a run of places of one pair (as in aaa)."""
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) > 1) | (pairs[1:] != pairs[:-1])
    starts = np.flatnonzero(new)
    return (np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))) % 2 == 0


def compress(ids: np.ndarray, min_count: int = 0) -> tuple[int, np.ndarray, list[int], np.ndarray, np.ndarray]:
    """(base, rules, rules of each round, expansion lengths, sequence) of the ids of one shard."""
    least = min_count or MIN_COUNT
    base = int(ids.max(initial=0)) + 1
    sequence, rules, rounds = ids.astype(np.uint32), [], []
    lengths = np.ones(base, np.uint32)
    places = np.arange(max(len(sequence) - 1, 0))  # where pairs begin that may be frequent
    while len(places):
        pairs = sequence[places].astype(np.uint64) << np.uint64(32) | sequence[places + 1]
        stay = _without_overlaps(pairs, places)
        ordered = np.sort(pairs[stay])
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        often = counts >= least
        if not often.any():
            break
        frequent, rank = ordered[starts[often]], np.empty(int(often.sum()), np.int64)
        rank[np.argsort(counts[often], kind="stable")] = np.arange(len(rank))
        at = np.minimum(np.searchsorted(frequent, pairs), len(frequent) - 1)
        hit = frequent[at] == pairs
        places, at, stay = places[hit], at[hit], stay[hit]
        taken = np.zeros(len(places), bool)
        taken[stay] = _winners(places[stay], rank[at[stay]])
        enough = np.bincount(at[taken], minlength=len(frequent)) >= least
        taken &= enough[at]
        used, rule = np.unique(at[taken], return_inverse=True)
        hits, first = places[taken], len(lengths)
        left, right = (frequent[used] >> np.uint64(32)).astype(np.uint32), frequent[used].astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        sequence[hits] = (first + rule).astype(np.uint32)
        keep = np.ones(len(sequence), bool)
        keep[hits + 1] = False
        moved = np.cumsum(keep) - 1
        gone = np.zeros(len(sequence), bool)  # pairs that lost a symbol to another, or were replaced
        gone[hits], gone[hits + 1] = True, True
        gone[hits[hits > 0] - 1] = True
        sequence = sequence[keep]
        new, waiting = moved[hits], moved[places[~taken & ~gone[places]]]
        places = np.unique(np.concatenate([new[new > 0] - 1, new, waiting]))
        places = places[places + 1 < len(sequence)]
        rules.append(np.stack([left, right], axis=1))
        rounds.append(len(used))
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return base, table, rounds, lengths[base:], sequence


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The token ids that symbols stand for: all nonterminals give way to their pairs, level by level."""
    while (wide := symbols >= base).any():
        size = 1 + wide.astype(np.int64)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[at] = symbols
        pair = rules[symbols[wide] - base]
        out[at[wide]], out[at[wide] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


class Shard:
    """Reader of one record."""

    def __init__(self, row: dict):
        array = lambda name, kind="<u4": np.frombuffer(row[name], kind)
        self.base, self.rules = row["base"], array("rules").reshape(-1, 2)
        self.sequence, self.doc_tokens = array("sequence"), array("doc_tokens").astype(np.int64)
        nulls = set(array("null_ids").tolist())
        self.doc_ids = [None if i in nulls else d for i, d in enumerate(array("doc_ids", "<i8").tolist())]
        lengths = np.concatenate([np.ones(self.base, np.uint32), array("lengths")])
        self.ends = np.cumsum(lengths[self.sequence], dtype=np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; expands only the symbols that cover them."""
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        skipped = int(self.ends[a - 1]) if a else 0
        return expand(self.sequence[a:b], self.base, self.rules)[start - skipped : stop - skipped]

    def document(self, i: int) -> np.ndarray:
        start = int(self.doc_tokens[:i].sum())
        return self.tokens(start, start + int(self.doc_tokens[i]))


def record(shard: int, doc_ids: list, encoded: list[bytes]) -> dict:
    base, rules, rounds, lengths, sequence = compress(np.frombuffer(b"".join(encoded), "<u4"))
    sizes = np.array([len(e) // 4 for e in encoded], "<u4")
    return {
        "shard": shard, "n_docs": len(doc_ids), "n_tokens": int(sizes.sum()), "base": base,
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(), "null_ids": np.array([i for i, d in enumerate(doc_ids) if d is None], "<u4").tobytes(),
        "doc_tokens": sizes.tobytes(), "rules": rules.astype("<u4").tobytes(), "rounds": np.array(rounds, "<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": sequence.astype("<u4").tobytes(),
    }


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SHARDS.split(", "))])


def write_shards(documents: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes and writes all documents; returns the table of records. Shard numbers ascend with doc_id.

    Ranges go by doc_id, then by a hash of the text, so that rows with equal or without doc_id spread over tasks.
    """
    schema = _arrow_schema()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        number, doc_ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for doc_id, ids in encoded(batches, tokenizer, True):
            doc_ids.append(doc_id)
            parts.append(ids + end)
            size += len(parts[-1])
            if size >= 4 * shard_tokens:
                yield pa.RecordBatch.from_pylist([record(number, doc_ids, parts)], schema)
                number, doc_ids, parts, size = number + 1, [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_pylist([record(number, doc_ids, parts)], schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("salt", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return written(ordered.mapInArrow(shards, SHARDS), "token-shards", compression="zstd")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            shard = Shard(row)
            starts = np.cumsum(shard.doc_tokens) - shard.doc_tokens
            ids = shard.tokens(0, row["n_tokens"]).astype("<u4")
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), shard.doc_tokens.tolist())]
            columns = [[row["shard"]] * row["n_docs"], shard.doc_ids, starts, shard.doc_tokens, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in DECODED.split(", ")])


def read_back(shards: DataFrame) -> DataFrame:
    """One row for each document, from the records: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    rows = shards.mapInArrow(_decoded, DECODED)
    before = prefix_sum(shards.select("shard", "n_tokens"), "shard", "n_tokens", "before").select("shard", "before")
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
