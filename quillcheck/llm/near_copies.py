"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its runs of SHINGLE words. Candidates come from two sides: the Golay keys of the SimHash fingerprints of
the sets, and bands, each of ROWS least values of the set under hash functions. Pairs at SIMILARITY differ in about 10 of 64
fingerprint bits, so the keys find the closest copies only; a pair misses all bands with a probability of 7 in 100,000.
Candidates are verified on the whole sets, whose shingles are told apart by 32 bits (of two sets of 600 shingles, one in
ten thousand pairs has a shingle too many in common).

Equal sets are made one first, so copies cost nothing. What counts is which texts hang together, so each member of a bucket is
verified against three leaders of the bucket first. Then only pairs of a bucket that are not yet connected remain. In small buckets these are
verified pair by pair; in larger ones those alone that share one of their rarest shingles (two sets of the similarity
always share one of the rarest fifth and one more), at places from which on they can still have enough in common. So sets
that only share what is common to all never meet, and no link between components is lost.

Defined results: null and wordless texts have the empty set and are copies of each other; texts of fewer than SHINGLE words
are one shingle; very long texts are sets like others; rows without doc_id, and repeated rows of a doc_id that stays, stay; of texts that tie the least
doc_id stays; an empty table stays empty; other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm import simhash
from quillcheck.llm.common import from_batches, scratch, written
from quillcheck.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 24, 5, 42
BUCKET = 32
_SLAB = 1 << 11


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the different runs of words, ascending."""
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w, SEED) for w in text.encode().lower().split()], np.uint64)
    width = min(words, len(each))
    if not width:
        return each
    run = np.zeros(len(each) - width + 1, np.uint64)
    for k in range(width):
        run = _mixed(run + each[k : len(each) - width + 1 + k])
    return np.unique(run)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of a set that is not empty."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), _SLAB):
        np.minimum(least, (found[at : at + _SLAB, None] * factors).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + row)
    return keys


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half of its hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _SLAB):
        ones += np.unpackbits(found[at : at + _SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


SKETCH = "doc_id long, node long, n int, fp long, keys array<long>, shingles array<int>"


def sketches(documents: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, node (a digest of the set), n (its size), fp (its SimHash), keys (of its bands) and shingles (32 bits of each, ascending)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(parts: list[np.ndarray], kind: type, signed: type) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *parts]).view(signed)))

        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                sets = [shingles(x or "", words) for x in from_batches(part, "text")]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                short = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
                keys = [band_keys(s) if len(s) else s for s in sets]
                columns = [part.column(0), pa.array(nodes), pa.array(list(map(len, short)), pa.int32()), pa.array(list(map(fingerprint, sets)), pa.int64()), lists(keys, np.uint64, np.int64), lists(short, np.uint32, np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, SKETCH)


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that have the similarity; the set of one side travels to the other's."""
    of = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
    both = pairs.distinct().join(of("a", "_a"), "a").join(of("b", "_b"), "b").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    return written(both.where(F.col("_n") >= similarity * (F.size("_a") + F.size("_b") - F.col("_n"))).select("a", "b"), "near-links")


def _in_reach(similarity: float) -> "F.Column":
    """Whether two sets of sizes n and _n can have the similarity."""
    return F.least("n", "_n") >= similarity * F.greatest("n", "_n")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal or linked by the Golay keys."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = _ordered(nodes.join(least, "fp"), "node", "rep")
    of = lambda c, r: least.select(F.col("fp").alias(c), F.col("rep").alias(r))
    near = simhash.links(nodes.select("fp").distinct()).join(of("a", "_a"), "a").join(of("b", "_b"), "b")
    return same.union(_ordered(near, "_a", "_b"))


def _across(members: DataFrame, by: str, similarity: float) -> DataFrame:
    """Pairs of members (node, n, root and, if ranked, at) with one value of by and different roots: all outside the most frequent root with all of others.

    at: the place of the shared value in the order of its set. What two sets can have in common from there on must be enough for the
    similarity, or the value is not the first that they share.
    """
    main = members.groupBy(by, "root").count().groupBy(by).agg(F.max_by("root", "count").alias("_main"), F.count("*").alias("_roots")).where("_roots > 1")
    outside = members.join(main, by).where("root <> _main").select(by, F.col("node").alias("_node"), F.col("root").alias("_root"), F.col("n").alias("_n"), *([F.col("at").alias("_at")] if "at" in members.columns else []))
    able = (F.col("_root") != F.col("root")) & _in_reach(similarity)
    if "at" in members.columns:
        able &= 1 + F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= similarity / (1 + similarity) * (F.col("n") + F.col("_n")) - 1e-9
    return _ordered(outside.join(members, by).where(able), "node", "_node")


def _rarest(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, n, root, at): of each set the rarest shingles among these sets, as many as sets of the similarity cannot miss, with their places from 1."""
    each = members.select("node", "root").distinct().join(sets, "node").select("node", "root", "n", F.explode("shingles").alias("shingle"))
    counted = each.join(each.groupBy("shingle").agg(F.count("*").alias("_often")), "shingle")
    sorted_sets = counted.groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("_often", "shingle"))).alias("_all"))  # one text's shingles
    few = (F.col("n") - F.ceil(F.col("n") * similarity) + 1).cast("int")
    placed = sorted_sets.select(F.posexplode(F.slice("_all", F.lit(1), few)).alias("at", "_x"), "node", "n", "root")
    return placed.where("_x._often > 1").select("_x.shingle", "node", "n", "root", (F.col("at") + 1).alias("at"))  # what one set alone has meets nothing


def links(sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b), a < b, of the similarity; nodes whose sets have it and share a key are always connected by edges."""
    first = lambda c: F.first(c).alias(c)
    nodes = written(sketched.select("node", "n", "fp", "keys").groupBy("node").agg(first("n"), first("fp"), first("keys")), "near-nodes")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    leaders = F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node"))))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("c"), leaders.alias("leaders")).where("c > 1")
    shared = written(keyed.join(crowds, "key"), "near-shared")
    close = written(_by_fingerprint(nodes).distinct(), "near-close")
    asked = written(shared.select("node").union(close.select("a")).union(close.select("b")).distinct(), "near-asked")  # a table, so that its true size decides how it is joined
    sets = written(sketched.select("node", "n", "shingles").join(asked, "node", "left_semi").dropDuplicates(["node"]), "near-sets", compression="zstd")
    found = _verified(close.union(_ordered(shared.select("node", F.explode("leaders").alias("_leader")), "node", "_leader")), sets, similarity)
    labels = components(found).withColumnRenamed("node", "_node")
    members = written(shared.join(labels, F.col("node") == F.col("_node"), "left").select("key", "node", "n", "c", F.coalesce("root", "node").alias("root")), "near-members")
    mixed = members.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("key")
    open_ = written(members.join(mixed, "key"), "near-open")
    small, large = open_.where(F.col("c") <= BUCKET), open_.where(F.col("c") > BUCKET)
    rest = _across(small, "key", similarity)
    if not large.isEmpty():
        rest = rest.union(_across(written(_rarest(large, sets, similarity), "near-rarest"), "shingle", similarity))
    return found.union(_verified(rest, sets, similarity))


def near_copies(documents: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id and component_id, the smallest doc_id that links reach."""
    with scratch(documents.sparkSession):
        sketched = written(sketches(documents, words), "near-sketches", compression="zstd")
        firsts = sketched.groupBy("node").agg(F.min("doc_id").alias("first_id"))
        labels = components(links(sketched, similarity)).withColumnRenamed("node", "_node")
        label = firsts.join(labels, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
        smallest = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
        found = sketched.select("doc_id", "node").join(label.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
        return written(found, "near-copies", keep=True)


def first_of_group(documents: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component: the one with its smallest doc_id."""
    gone = near_copies(documents, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"] == F.col("_gone"), "left_anti")
