"""Fingerprints against a plain version: every window looked at, hashes by Python integers."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillcheck.llm import winnowing

_M = (1 << 64) - 1
SCHEMA = "doc_id long, text string, `a.b` int, part int, tie string"


def _mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _M
    return h ^ (h >> 31)


def _plain(text, k=winnowing.K, w=winnowing.W):
    width, down = min(k, len(text)), winnowing._INVERSE
    hashes = [_mixed(sum((ord(text[i + t]) + 1) * pow(down, t, 1 << 64) for t in range(width)) & _M) for i in range(len(text) - width + 1)] if text else []
    kept = set()
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[i : i + w]
        kept.add(i + max(j for j, h in enumerate(window) if h == min(window)))
    return [(hashes[i], i) for i in sorted(kept)]


def _rows(documents):
    order = sorted(documents, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, other = _plain(text), _plain(edited), _plain(following)
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        sets = [{h for h, _ in x} for x in (own, new, other)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *(",".join(f"{h:016x}@{at}" for h, at in x) for x in (own, new)), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return out


def _key(row):
    return tuple((x is not None, x) if i == 0 else x for i, x in enumerate(row))


def _documents():
    words = ["lorem", "ipsum", "dolor", "sit", "große", "слово", "\U0001f600x", "aaaa"]
    rng = np.random.default_rng(5)
    docs = [(int(i) * 7 - 50, " ".join(rng.choice(words, size=int(rng.integers(0, 60))))) for i in range(60)]
    docs += [(9_007_199_254_740_993, "a" * 500), (9_007_199_254_740_992, "b" * 3), (-(1 << 63), "x"), ((1 << 63) - 1, None), (1000, ""), (1001, "lorem " * 4000)]
    return docs


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \U0001f600é", max_size=90), st.integers(1, 9), st.integers(1, 9))
def test_winnowing_keeps_the_rightmost_least_hash_of_each_window(text, k, w):
    hashes, at = winnowing.winnowed(winnowing.code_points(text), k, w)
    assert list(zip(hashes.tolist(), at.tolist())) == _plain(text, k, w)


def test_shared_stretches_of_the_promised_length_share_a_hash():
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(97, 123, n).astype(np.uint32)
    for _ in range(50):
        shared = draw(winnowing.K + winnowing.W - 1)
        a, b = (winnowing.winnowed(np.concatenate([draw(70), shared, draw(70)]))[0] for _ in range(2))
        assert len(np.intersect1d(a, b))


def test_query_rows_equal_the_plain_version(spark):
    docs = _documents() + [(None, "no id")]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], SCHEMA).repartition(3)
    got = [tuple(r) for r in winnowing.edited_likeness(df).collect()]
    assert sorted(got, key=_key) == sorted(_rows(docs), key=_key)


def test_repeated_rows_single_documents_and_empty_tables(spark):
    make = lambda rows: winnowing.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert make([]) == []
    one = make([(3, "abcd")])
    assert [(r["doc_id"], r["near_next"], r["edited_sha256"]) for r in one] == [(3, 1.0, hashlib.sha256(b"abab").hexdigest())]
    rows = make([(1, "same words " * 9)] * 5 + [(None, None)] * 3 + [(2, "")])
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 0, 0, 1, 1, 1, 1, 1, 2]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1 and {r["fingerprint"] for r in rows if r["doc_id"] != 1} == {""}


def test_fingerprints_as_columns(spark):
    docs = [(1, "lorem ipsum " * 20), (2, None), (3, "ab")]
    got = {r["doc_id"]: [(h & _M, at) for h, at in zip(r["hashes"], r["positions"])] for r in winnowing.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: _plain(text or "") for i, text in docs}
