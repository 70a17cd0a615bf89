"""The mix of sources reaches the packed sequences."""

import random
from collections import Counter

import corpus_pipeline
from quillcheck.llm import mixing, packing
from quillcheck.llm.common import written
from tests.llm.fixtures import SCHEMA


def test_shares_of_any_range_follow_the_mix(spark, monkeypatch):
    rng = random.Random(3)
    # the sources have documents of different lengths, so an order by length would part them
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range((20, 60, 200)[i % 3] + rng.randrange(9))), "en", f"s{i % 3}", 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = written(mixing.in_order(docs, weights={"s0": 1.0, "s1": 1.0, "s2": 1.0}, block=1200), "mixed")
    in_order = packing.pack_in_order
    monkeypatch.setattr(packing, "pack_in_order", lambda d, t: in_order(d, t, size=256, window=4096))
    got = corpus_pipeline.packed(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(range(1500))
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 256 and set(used) == set(range(len(used)))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, Counter())[r.doc_id % 3] += r.length
    horizon = sum(r.length for r in got if r.doc_id % 3 == 0) * 3 // 256 * 9 // 10  # before the shortest source runs out
    for at in range(0, horizon - 64, 16):
        share = sum((by_sequence[k] for k in range(at, at + 64)), Counter())
        assert all(0.2 < share[s] / share.total() < 0.47 for s in range(3)), (at, share)
    assert sum(used[k] for k in range(horizon)) / (256 * horizon) > 0.9  # behind it, long documents alone leave gaps
