"""Repeated passages of over 50 words go at any offset, whatever their marks."""

import random

import pytest

from quillcheck.llm import substring_dedup
from tests.llm.fixtures import documents


def fresh(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(100_000)}" for _ in range(n)]


@pytest.mark.parametrize("mark", ["", ",", "!!", " ;"])
@pytest.mark.parametrize("kind", ["words", "lines", "shout"])
def test_passages_go_at_any_offset(spark, mark, kind):
    rng = random.Random(5)
    passage = ["WORD"] * 90 if kind == "shout" else fresh(rng, 90)
    sep = "\n" if kind == "lines" else " "
    rows = []
    for i in range(25):
        before, after = fresh(rng, 20 + i), fresh(rng, 30)
        rows.append((i, f"{' '.join(before)} {sep.join(w + mark for w in passage)} {' '.join(after)}", "en", "s", 1))
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(documents(spark, rows)).collect()}
    for i, text, *_ in rows:
        left = sum(w.strip(",!;") in set(passage) for w in got[i].split())
        if i:
            assert left <= 24, (i, left)
            assert all(w in got[i] for w in text.split()[:8])
    first = sum(w.strip(",!;") in set(passage) for w in got[0].split())
    assert first <= 90 if kind == "shout" else first == 90


def test_units():
    rng = random.Random(6)
    passage = fresh(rng, 51)
    whole = []
    for _ in range(60):
        text = "\t" + " ".join(fresh(rng, rng.randrange(1, 40)) + passage + fresh(rng, 30))
        units = substring_dedup.units(text)
        assert "".join(units) == text
        assert all(substring_dedup.NEAR < len(u.split()) <= substring_dedup.LONG + substring_dedup.NEAR for u in units)
        whole.append({u for u in units if set(u.split()) <= set(passage)})
    assert len(set.intersection(*whole)) >= substring_dedup.SPAN
    assert substring_dedup.units("") == [] and substring_dedup.units(" \n") == [" \n"]
