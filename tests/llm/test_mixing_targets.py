"""Slots of the mix against the weights asked for, over many periods and sources."""

from fractions import Fraction

import pytest

from quillcheck.llm import mixing
from tests.llm.fixtures import SCHEMA


@pytest.mark.parametrize("n", [3, 20, 1000])
def test_every_source_is_less_than_a_block_from_its_target(n):
    weights = {"hot": 1 / 3, "zero": 0.0, **{f"s{i}": 2 / 3 / (n - 1) * (1 + i % 3) / 2 for i in range(n - 1)}}
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    done, seen = dict.fromkeys(weights, 0), 0
    for s, j, slot, release, deadline, balanced in mixing.schedule(weights, dict.fromkeys(weights, 10_000)):
        assert slot == seen and balanced and j == done[s] and release <= slot < deadline
        done[s] += 1
        seen += 1
        assert abs(done["hot"] - seen * share["hot"]) < 1 and abs(done["s1"] - seen * share["s1"]) < 1
        if seen == 12_000:
            break
    assert all(abs(done[s] - seen * share[s]) < 1 for s in weights) and not done["zero"]


def test_mix_follows_weights(spark):
    rows = [(i, "x" * 99, "en", "hot" if i % 2 else f"s{i % 40}", 1) for i in range(4000)]
    weights = {"hot": 10.0, **{f"s{i}": 1.0 for i in range(0, 38, 2)}, "s38": 0.0}
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=weights, block=100, period=16).orderBy("position").collect()
    done, seen = 0, 0
    for r in got:
        if not r.balanced:
            break
        done, seen = done + (r.source == "hot"), seen + 1
        assert abs(done - seen * 10 / 29) < 1 and r.source != "s38"
    assert seen > 2500 and len(got) == 4000 and {r.source for r in got[-100:]} == {"s38"}
