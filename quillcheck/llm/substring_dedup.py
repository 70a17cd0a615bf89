"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences (after . ! ? or a line end), and each run of SPAN consecutive sentences is
hashed: lower-cased words, marks at the ends of words left out. Sentences can be long, or none: so
the text is cut a second time, into units of NEAR + 1 to LONG words at places that the words themselves
decide: after a word whose rank is less than those of the NEAR words on either side. Words at the end of
a sentence, clause or line rank before all others, then hashes of the words decide, so a passage is cut
the same way wherever it begins. Stretches of more than LONG words without such a place (words that
repeat with a short period) are cut after every CHUNK words, a prime greater than such a period, so that
all phases occur. Runs of SPAN units are hashed alike. A span has MIN_WORDS words.

Hashes are joined over all documents; the first occurrence, by doc_id and place, keeps its text, and
what any other occurrence covers is removed. Spans overlap, so a long passage is covered whole, but for
the units that its ends cut.

Each document sends a hash once. Whether an occurrence is the first follows from the smallest key of
its hash, and inside that document from its place, so the global part counts and joins pairs of longs
only. The key of a row is its doc_id. Rows without doc_id, and rows whose doc_id is not the only one,
are written first and get keys of their own, after all others, so no key stands for two rows.

Defined results: a null text has no spans and stays null; texts shorter than a span are never
changed; each row is a document of its own, so of repeated rows one keeps its text; rows without
doc_id, or with one that repeats, come after all others; repeated spans inside a text are removed
like any others; an empty table gives an empty result; other columns pass unread, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.llm.common import from_batches, packed, written

SPAN, MIN_WORDS, NEAR, LONG, CHUNK = 3, 10, 3, 9, 5
ENDS, MARKS = ".!?", ".!?,;:"
#: A word with the marks that stand alone behind it.
WORD = re.compile(rf"\S+\s*+(?:[{MARKS}]++(?!\S)\s*+)*+")
_KNOWN, LONGEST = 1 << 18, 64


def _rank(word: str) -> int:
    """A hash; words at the end of a sentence, clause or line come before others. Bit 0: end of a sentence or line."""
    bare = word.strip()
    line = "\n" in word
    closes = line or bare[-1:] in ENDS
    return xxhash.xxh64_intdigest(bare.lower().strip(MARKS + " \t\n")) >> 3 << 1 | (not (line or bare[-1:] in MARKS)) << 62 | closes


class _Ranks(dict):
    """Ranks of words; those of long words are not kept."""

    def __missing__(self, word: str) -> int:
        rank = _rank(word)
        if len(word) <= LONGEST:
            self[word] = rank
        return rank


_ranks = _Ranks()


def words_of(text: str) -> tuple[list[str], np.ndarray]:
    """The text in words with the white space behind them (joined they are the text), and their ranks."""
    words = WORD.findall(text)
    if not words:
        return ([text] if text else []), np.zeros(int(text != ""), np.int64)
    words[0] = text[: len(text) - sum(map(len, words))] + words[0]
    if len(_ranks) > _KNOWN:
        _ranks.clear()
    return words, np.fromiter(map(_ranks.__getitem__, words), np.int64, len(words))


def sentence_ends(rank: np.ndarray) -> list[int]:
    """Places in the words where a sentence ends."""
    ends = (np.flatnonzero(rank & 1) + 1).tolist()
    return ends if ends and ends[-1] == len(rank) else [*ends, len(rank)]


def unit_ends(rank: np.ndarray) -> list[int]:
    least = np.ones(len(rank), bool)
    for k in range(1, NEAR + 1):
        least[:-k] &= rank[:-k] < rank[k:]
        least[k:] &= rank[k:] < rank[:-k]
    places = [int(i) + 1 for i in np.flatnonzero(least)]
    if places and places[0] <= NEAR:
        del places[0]
    if places and len(rank) - places[-1] <= NEAR:
        del places[-1]
    found, at = [], 0
    for end in [*places, len(rank)]:
        while end - at > LONG:
            at += CHUNK
            found.append(at)
        found.append(end)
        at = end
    return found


def units(text: str) -> list[str]:
    """The text in units; joined they are the text."""
    words, rank = words_of(text)
    ends = unit_ends(rank) if words else []
    return ["".join(words[a:b]) for a, b in zip([0, *ends], ends)]


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def spans(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text and the spans of its sentences and units: hashes, first words and words after the last, by their first words.

    A span's hash is a polynomial of the hashes of its words, from running sums.
    """
    words, rank = words_of(text)
    up, down = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((rank.astype(np.uint64) >> np.uint64(1) & np.uint64((1 << 61) - 1)) * up[1:], out=sums[1:])
    starts, stops, families = [], [], []
    for family, ends in enumerate((sentence_ends(rank), unit_ends(rank)) if words else ()):
        ends = np.array([0, *ends], np.int64)
        start, stop = ends[: len(ends) - SPAN], ends[SPAN:]
        long = stop - start >= MIN_WORDS
        starts.append(start[long])
        stops.append(stop[long])
        families.append(np.full(int(long.sum()), family, np.uint64))
    start, stop, family = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, stops, families))
    h = (sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + family.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))).view(np.int64)
    order = np.lexsort((stop, start))
    return words, h[order], start[order], stop[order]


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hashes, again = [], [], []
        for key, text in zip(from_batches(batch, "key"), from_batches(batch, "text")):
            found, n = np.unique(spans(text or "")[1], return_counts=True)
            keys.append(np.full(len(found), key, np.int64))
            hashes.append(found)
            again.append(n > 1)
        columns = [np.concatenate([np.zeros(0, kind), *c]) for c, kind in ((keys, np.int64), (hashes, np.int64), (again, bool))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "hash", "again"])


def keyed(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, text, rec) with a key of their own each, and (key, doc_id) of those whose key is not their doc_id, if there are any."""
    whole = packed(documents).select("rec", F.col("rec.doc_id").cast("long").alias("doc_id"), F.col("rec.text").cast("string").alias("text"))
    counts = whole.groupBy("doc_id").agg(F.count("*").alias("n"))
    several = written(counts.where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    top, nulls = counts.agg(F.max("doc_id"), F.max(F.when(F.col("doc_id").isNull(), F.col("n")))).first()
    single = whole.withColumn("key", F.col("doc_id"))
    if not nulls and several.isEmpty():
        return single.select("key", "text", "rec"), None
    others = whole.where("doc_id is null").unionByName(whole.join(several, "doc_id", "left_semi").select(whole.columns))
    row = F.monotonically_increasing_id()
    key = row + F.lit((top if top is not None else -1) + 1) if (top or 0) < 1 << 62 else F.xxhash64(row)  # ids that leave no room: by hash
    others = written(others.withColumn("key", key), "rows-without-own-id", compression="zstd")
    single = single.where("doc_id is not null").join(several, "doc_id", "left_anti")
    return single.select("key", "text", "rec").unionByName(others.select("key", "text", "rec")), others.select("key", "doc_id")


def repeated(rows: DataFrame) -> DataFrame:
    """(key, hash, first_key): spans that occur more than once, for each row that has them."""
    sent = written(rows.select("key", "text").mapInArrow(_sent, "key long, hash long, again boolean"), "spans", compression="zstd")
    first = sent.groupBy("hash").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.max("again").alias("again"))
    first = first.where("first_key <> last_key or again").select("hash", "first_key")
    return sent.join(first, "hash").select("key", "hash", "first_key")


def removed_words(found: Iterator[tuple[int, int, int]], first: dict[int, int], key: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Ranges of words that go, in order and apart, and the first keys of the spans that remove them. first: by hash."""
    ranges: list[tuple[int, int]] = []
    seen, origins = set(), set()
    for h, a, b in found:
        if h in first:
            if first[h] != key or h in seen:
                origins.add(first[h])
                if ranges and a <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
                else:
                    ranges.append((a, b))
            seen.add(h)
    return ranges, origins


ADDED = {"n_words": "long", "n_removed": "long", "removed": "string", "first_keys": "array<long>"}


def deduplicated(documents: DataFrame, changed_only: bool = False) -> DataFrame:
    """documents without the text of repeated spans, and for each n_words, n_removed (words), removed (start:end in code points) and first_doc_ids.

    changed_only: only rows that lose text.
    """
    rows, own = keyed(documents)
    found = repeated(rows).groupBy("key").agg(F.collect_list(F.struct("hash", "first_key")).alias("spans"))  # at most the spans of one text
    joined = rows.select("key", "rec").join(found, "key", "inner" if changed_only else "left")
    fields = {f.name: f for f in documents.schema.fields}
    kept = T.StructType([T.StructField(n, T.StringType()) if n == "text" else f for n, f in fields.items()])
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("rec", kept), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in ADDED.items())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, facts = [], []
            record = batch.column("rec")
            inner = dict(zip(fields, record.flatten()))
            for key, text, known in zip(from_batches(batch, "key"), inner["text"].cast(pa.string()).to_pylist(), from_batches(batch, "spans")):
                words, *all_spans = spans(text or "")
                ranges, origins = removed_words(zip(*(x.tolist() for x in all_spans)), {s["hash"]: s["first_key"] for s in known or ()}, key)
                ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).tolist()
                places = [(ends[a], ends[b]) for a, b in ranges]
                left = [(text or "")[a:b] for a, b in zip([0, *(b for _, b in places)], [*(a for a, _ in places), len(text or "")])]
                texts.append(text if text is None else "".join(left))
                facts.append((len(words), sum(b - a for a, b in ranges), ",".join(f"{a}:{b}" for a, b in places), sorted(origins)))
            inner["text"] = pa.array(texts, pa.string())
            record = pa.StructArray.from_arrays(list(inner.values()), fields=[pa.field(n, c.type) for n, c in inner.items()])
            new = [pa.array(c, k) for c, k in zip(list(zip(*facts)) or [()] * 4, kinds)]
            out = pa.RecordBatch.from_arrays([batch.column("key"), record, *new], names=["key", "rec", *ADDED])
            yield out.filter(pa.compute.greater(out.column("n_removed"), 0)) if changed_only else out

    done = joined.mapInArrow(cut, schema)
    if own is None:
        ids = done.withColumn("first_doc_ids", F.col("first_keys"))
    else:  # keys back to ids, for the few that are no ids; a key without doc_id has none
        done = written(done, "deduplicated", compression="zstd")
        names = own.select(F.col("key").alias("first"), F.col("doc_id").alias("of"), F.lit(True).alias("mapped"))
        each = done.select("key", F.explode("first_keys").alias("first")).join(names, "first", "left").select("key", F.when(F.col("mapped"), F.col("of")).otherwise(F.col("first")).alias("id"))
        ids = done.join(each.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("first_doc_ids")), "key", "left").withColumn("first_doc_ids", F.coalesce("first_doc_ids", F.array().cast("array<long>")))
    added = [n for n in (*list(ADDED)[:3], "first_doc_ids")]
    return ids.select(*(F.col("rec")[n].alias(n) for n in fields if n not in added), *added)
