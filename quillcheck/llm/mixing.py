"""Mixing sources to target weights by Pfair scheduling of source blocks.

A source's documents, in doc_id order, are cut into blocks of about BLOCK units (a document weighs
its code points and one). Block j of a source with weight w is released at slot floor(j / w) and is
due by slot ceil((j + 1) / w). Taking in each slot the released block with the earliest deadline
meets all deadlines, so at any slot every source is less than one block away from its share.

Weights are exact fractions and nothing is rounded or repeated: the blocks are scheduled in one task
that reads one row a source, keeps one block of each at a time and passes its rows on. Its work has a
bound: a block has BLOCK units, or more in tables that would have over MOST blocks, plus one a source.
Sources are things such as crawls and collections, some thousands at most; their number is not
bounded here. A document's place then is the number of documents in earlier slots and before it in
its block. No document is dropped or repeated: a source that has run out leaves its slots to the
others, and balanced says whether a document comes before the first such slot. Sources of weight zero
come after all others, block by block.

Defined results: documents without source form a source of their own; a null text weighs one; rows
without doc_id come first in their source; equal doc_ids stand next to each other in no particular
order; if no source has a weight, all come block by block; an empty table gives an empty result;
columns of the input named like an added one are replaced, other names cannot clash.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.llm.common import packed, prefix_sum, written

BLOCK, MOST, PERIOD, TEMPERATURE = 1 << 18, 1 << 22, 1024, 0.5
#: Slots are longs; blocks that are due later follow the schedule.
LAST_SLOT = 1 << 61
ADDED = ("block", "slot", "release", "deadline", "position", "balanced")


def shares(weights: dict[str, float], period: int) -> dict[str, Fraction]:
    """Slots of each source in a period, exactly."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values()) or 1
    return {s: period * w / total for s, w in exact.items()}


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(source, block, slot, release, deadline, balanced) of all blocks of the sources, earliest deadline first."""
    rate = {s: w for s, w in shares(weights, 1).items() if w}
    late = {s: 0 for s in weights if s not in rate}  # first block after the schedule

    def window(s: str, j: int) -> tuple[int, int]:
        w = rate[s]
        return j * w.denominator // w.numerator, -(-(j + 1) * w.denominator // w.numerator)

    waiting = [(0, s, 0) for s in sorted(rate)]  # (release, source, block), the next one of each source
    ready: list[tuple[int, str, int, int]] = []
    slot, balanced = 0, True
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        if j == blocks[s]:  # the source has run out
            balanced = False
            continue
        yield s, j, slot, release, deadline, balanced
        slot += 1
        after = window(s, j + 1)
        if after[1] > LAST_SLOT:
            late[s] = j + 1
        else:
            heapq.heappush(waiting, (after[0], s, j + 1))
    for s, j in ((s, j) for s in sorted(late) for j in range(late[s], blocks[s])):
        yield s, j, slot, slot, slot + 1, False
        slot += 1


def mix(documents: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, carry: list[str] | None = None) -> DataFrame:
    """documents (or only the columns of carry) with block, slot, release, deadline, position and balanced.

    weights: by source, a source without weight has weight zero. None: the share of each source's
    units to the power TEMPERATURE. period: slots that the scheduling task passes on at a time.
    """
    kept = [c for c in carry or documents.columns if c not in ADDED]
    source = F.coalesce(F.concat(F.lit("s"), F.col("all.source").cast("string")), F.lit("n"))
    units = F.length(F.coalesce(F.col("all.text").cast("string"), F.lit(""))).cast("long") + 1
    whole = packed(documents).withColumnRenamed("rec", "all")
    rows = whole.select(F.struct(*(F.col("all")[c].alias(c) for c in kept)).alias("rec"), F.col("all")["doc_id"].alias("id"), source.alias("source"), units.alias("units"), F.xxhash64(F.col("all")["text"].cast("string")).alias("salt"))
    ordered = rows.repartitionByRange("source", "id", "salt").sortWithinPartitions("source", "id", "salt")
    ordered = written(ordered.withColumn("part", F.spark_partition_id().cast("long")).withColumn("row", F.monotonically_increasing_id()), "mix-rows", compression="zstd")

    # units before each document in its source: in its part, and in the parts before
    light = ordered.select("row", "source", "part", "units")
    parts = light.groupBy("source", "part").agg(F.sum("units").alias("n"))
    before = prefix_sum(parts, "part", "n", "before", within=("source",)).select("source", "part", "before")
    size = max(block, -(-(parts.agg(F.sum("n")).first()[0] or 0) // MOST))
    inside = F.coalesce(F.sum("units").over(Window.partitionBy("source", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = light.withColumn("inside", inside).join(before, ["source", "part"]).select("row", "source", "units", F.expr(f"(inside + before) div {size}").alias("block"))
    blocks = written(blocks, "mix-blocks")

    totals = blocks.groupBy("source").agg(F.sum("units").alias("n"), (F.max("block") + 1).alias("blocks"))  # one row a source
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
    names = ["source", "block", "slot", "release", "deadline", "balanced"]

    def scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in b.to_pylist()]
        target = {r["source"]: (weights or {}).get(r["source"][1:] if r["source"][0] == "s" else None, 0.0) if weights else r["n"] ** TEMPERATURE for r in found}
        made = schedule(target, {r["source"]: r["blocks"] for r in found})
        while part := list(itertools.islice(made, period)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    slots = written(totals.coalesce(1).mapInArrow(scheduled, "source string, block long, slot long, release long, deadline long, balanced boolean"), "mix-slots")
    timed = blocks.join(slots, ["source", "block"]).select("row", *names[1:])

    sizes = timed.groupBy("slot").agg(F.count("*").alias("n"))
    first = prefix_sum(sizes, "slot", "n", "first").select("slot", "first")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("row")) - 1  # a slot holds one block
    placed = timed.withColumn("rank", rank).join(first, "slot").withColumn("position", (F.col("first") + F.col("rank")).cast("long"))
    return ordered.select("row", "rec").join(placed.select("row", *ADDED), "row").select(*(F.col("rec")[c].alias(c) for c in kept), *ADDED)


def in_order(documents: DataFrame, **parameters) -> DataFrame:
    """documents, all columns, as files whose rows follow the mix."""
    whole = packed(documents).select("rec", *(F.col("rec")[c].alias(c) for c in ("doc_id", "source", "text")))
    ordered = mix(whole, carry=["rec"], **parameters).repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*(F.col("rec")[c].alias(c) for c in documents.columns))
