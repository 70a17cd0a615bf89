"""Schedules, fingerprints of media and distinct n-grams against plain versions of them."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillcheck.llm import lm_score, media, mixing


def plain_schedule(weights, blocks):
    """Slot by slot, over all sources each time."""
    total = sum(map(Fraction, weights.values()))
    rate = {s: Fraction(w) / total for s, w in weights.items() if w}
    done, out, slot, balanced = Counter(), [], 0, True
    while any(done[s] <= blocks[s] for s in rate):
        ready = []
        for s, w in rate.items():
            j = done[s]
            if j <= blocks[s] and (j / w).__floor__() <= slot:
                ready.append((-(-(j + 1) / w).__floor__(), s, j, (j / w).__floor__()))
        if not ready:
            slot += 1
            continue
        deadline, s, j, release = min(ready)
        done[s] += 1
        if j == blocks[s]:
            balanced = False
            continue
        out.append((s, j, slot, release, deadline, balanced))
        slot += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule(seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.choice([1, 2, 5, 12]))]
    weights = {s: rng.choice([1, 2, 3, 0.1, 7, 1 / 3]) for s in names}
    blocks = {s: rng.randrange(0, 25) for s in names}
    assert list(mixing.schedule(weights, blocks)) == plain_schedule(weights, blocks)


def plain_fingerprint(payload):
    """Peaks frame by frame and pairs one by one."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)
    window = np.hanning(media.FRAME).astype(np.float32)
    level, at = [], []
    for begin in range(0, len(samples) - media.FRAME + 1, media.HOP):
        power = np.abs(np.fft.rfft(samples[begin : begin + media.FRAME] * window))
        best = [max(range(lo, hi), key=lambda b: (power[b], -b)) for lo, hi in media.BANDS]
        at.append(best)
        level.append([round(20 * float(np.log10(power[b] + 1e-6))) for b in best])
    peaks = []
    for t in range(len(level)):
        for k in range(len(media.BANDS)):
            before = [level[u][k] for u in range(max(0, t - media.AROUND), t)]
            after = [level[u][k] for u in range(t + 1, min(len(level), t + media.AROUND + 1))]
            if all(level[t][k] > x for x in before) and all(level[t][k] >= x for x in after):
                peaks.append((t, at[t][k]))
    pairs = []
    for i, (t, f) in enumerate(peaks):
        for u, g in peaks[i + 1 : i + 1 + media.FAN]:
            if u - t <= media.REACH:
                pairs.append((t, f << 13 | g << 6 | (u - t)))
    return sorted(pairs)


@pytest.mark.parametrize("n", [1, 2, 40, 400])
def test_media_fingerprint(n):
    rng = np.random.default_rng(n)
    payload = rng.integers(32, 127, 192 * n).astype(np.uint8).tobytes()
    time, code = media.fingerprint(np.frombuffer(payload, np.uint8))
    assert list(zip(time.tolist(), code.tolist())) == plain_fingerprint(payload)


@pytest.mark.parametrize("wide", [False, True])
def test_distinct_pairs(wide):
    rng = np.random.default_rng(wide)
    context, word = rng.integers(0, 50, 3000), rng.integers(0, 40, 3000)
    if wide:  # too wide for one sort
        context, word = context << 20, word << 24
    c, w, of = lm_score._distinct(context, word)
    pairs = sorted(set(zip(context.tolist(), word.tolist())))
    assert list(zip(c.tolist(), w.tolist())) == pairs and [pairs[i] for i in of] == list(zip(context.tolist(), word.tolist()))
