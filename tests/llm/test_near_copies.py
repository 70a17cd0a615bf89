"""Near copies against all pairs, and in the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from quillcheck.llm import near_copies
from tests.llm.fixtures import SCHEMA, documents, edge_rows


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted():
    """Texts, and copies of them with some words changed, around the threshold."""
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 700]))]
        rows.append((1000 + 10 * i, " ".join(words), "en", "s", 1))
        for k in range(1, 4):
            other = list(words)
            for _ in range(max(1, len(words) * k * (i % 5 + 1) // 400)):
                other[rng.randrange(len(other))] = f"new{rng.randrange(5000)}"
            rows.append((1000 + 10 * i + k, " ".join(other), "en", "s", 1))
    return rows


@pytest.mark.parametrize("bucket", [1, 32])
def test_stage_drops_planted_near_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    rows = [r for r in edge_rows() if r[0] is not None] + planted()
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 10 * len(a & b) >= 8 * len(a | b):
                near += a != b
                root[find(i)] = find(j)
    assert near > 40
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    stays = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert {r.doc_id for r in stays.collect()} == set(least.values())
    assert near_copies.first_of_group(spark.createDataFrame([], SCHEMA)).count() == 0
