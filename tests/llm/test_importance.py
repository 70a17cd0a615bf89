"""Resampling against a plain version, the cutoff against a full sort."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillcheck.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, `a.b` int, score string, rank int"


def _features(text, longest=1, buckets=importance.BUCKETS):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def _plain(docs, target, longest=1, buckets=importance.BUCKETS, percent=10, min_words=20):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in _features(text, longest, buckets)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(sum(s) + buckets) / (float(s[b] + 1) * float(sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n_words, found = _features(text, longest, buckets)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in rows), key=str)


def _documents(n=300, seed=3):
    rng = random.Random(seed)
    words = ["lorem", "Ipsum", "DOLOR", "größe", "Слово", "x", "1234", "a" * 80, " ", "don't", "日本語", "tab\tline\n"]
    docs = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(0, 90)))) for i in range(n)]
    return docs + [(-1, None), (-2, ""), (-3, "!?"), (None, "lorem " * 30), (10**12, "w" * 5000 + " lorem" * 3000)]


@pytest.mark.parametrize("longest", [1, 3])
def test_rows_equal_the_plain_version(spark, longest):
    docs, target = _documents(), ["lorem ipsum größe", None, "", "1234 слово lorem x x x"]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA).repartition(4)
    got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain(docs, target, longest)


def test_features_do_not_depend_on_slabs(monkeypatch):
    texts = pa.array([x for _, x in _documents(60)] + [None] * 3)
    flat = lambda: [(row + int(r), int(b)) for row, _, _, rows, found in importance.features(texts, 2) for r, b in zip(rows, found)]
    whole = sorted(flat())
    monkeypatch.setattr(importance, "SLAB", 64)
    assert sorted(flat()) == whole
    sliced = [(7 + row + int(r), int(b)) for row, _, _, rows, found in importance.features(texts.slice(7, 20), 2) for r, b in zip(rows, found)]
    assert sorted(sliced) == [x for x in whole if 7 <= x[0] < 27]


def test_sums_carry_on():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, sizes = rng.integers(0, 4000, 200), rng.integers(0, 300, 200)
    before = rng.integers(0, 1 << 32, 200).astype(np.uint32)
    want = [zlib.crc32(data[s : s + n].tobytes(), int(b)) for s, n, b in zip(starts, sizes, before)]
    assert importance.crc_of(data, starts, sizes, before).tolist() == want


def test_a_bracket_that_misses_the_rank_is_widened(spark):
    scored = spark.range(1000).selectExpr("id * 10 AS score")
    for rank in (1, 2, 500, 999, 1000):
        low, high, above = importance.bracket(scored, rank, 1000, accuracy=4)  # a sketch this coarse is often wrong
        want = (1000 - rank) * 10
        assert low <= want <= high and above == sum(10 * i > high for i in range(1000)) < rank


def test_ties_repeats_and_empty_tables(spark):
    target = spark.createDataFrame([("b",)], "text string")
    make = lambda rows: importance.resampled(spark.createDataFrame(rows, "doc_id long, text string"), target).collect()
    assert make([]) == []
    assert [r["rank"] for r in make([(1, "a")])] == [None]
    same = make([(5, "a " * 25)] * 40)  # all tie, in score and doc_id
    assert sorted(r["rank"] or 0 for r in same) == [0] * 36 + [1, 2, 3, 4]
    nobody = importance.resampled(spark.createDataFrame([(i, "a " * 25) for i in range(30)], "doc_id long, text string"), target.where("false"))
    assert sorted(r["rank"] for r in nobody.collect() if r["rank"]) == [1, 2, 3]
