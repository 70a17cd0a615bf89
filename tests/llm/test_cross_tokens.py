"""Alignment against a plain version: whole texts encoded, ends compared as sets, all overlaps counted."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillcheck.llm import cross_tokens
from quillcheck.llm.token_ids import byte_characters

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, `a.b` int, n_a string, block int"


def _tokens(text):
    a_of, b_of = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_of.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_characters())}
    a = [(i, bytes(byte[c] for c in a_of.id_to_token(i))) for i in a_of.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()) for i in b_of.encode(text)]
    if not text or any(b"".join(x for _, x in side) != f" {text}".encode() for side in (a, b)):
        return [], []
    return a, b


def _ends(side):
    return np.cumsum([len(x) for _, x in side]).tolist()


def _plain(docs):
    rows, links = [], []
    for doc_id, text in docs:
        a, b = _tokens(text or "")
        ends_a, ends_b = _ends(a), _ends(b)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(str(t) for t, _ in a[i:x])}|{','.join(str(t) for t, _ in b[j:y])}")
            i, j = x, y
        links.append([(p, q) for (p, w), e in zip(a, ends_a) for (q, v), f in zip(b, ends_b) if e - len(w) < f and f - len(v) < e])
        rows.append([doc_id, len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    n = Counter(p for x in links for p in set(x))
    most = {}
    for (p, _), k in n.items():
        most[p] = max(k, most.get(p, 0))
    return sorted(((*r[:5], sum(n[p] == most[p[0]] for p in x), sum(n[p] for p in x), r[5]) for r, x in zip(rows, links)), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=60), st.data())
def test_align_finds_all_common_ends(sizes, data):
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    drop = data.draw(st.sets(st.sampled_from(ends[:-1].tolist()) if len(ends) > 1 else st.nothing()))
    more = data.draw(st.sets(st.integers(1, max(1, total - 1)), max_size=8))
    other = np.array(sorted((set(ends.tolist()) - drop) | {m for m in more if m < total}), np.int64)
    got = cross_tokens.align(ends, other)
    runs, groups = list(zip(got.run_a, got.run_b, got.run_n)), list(zip(got.group_a, got.end_a, got.group_b, got.end_b))
    found = sorted([(i + k, i + k + 1, j + k, j + k + 1) for i, j, n in runs for k in range(n)] + groups)
    common = sorted(set(ends.tolist()) & set(other.tolist()))
    assert [int(ends[g[1] - 1]) for g in found] == common == [int(other[g[3] - 1]) for g in found] and got.n_groups() == len(found)
    assert all(p[1] == q[0] and p[3] == q[2] for p, q in zip(found, found[1:]))
    i, j = got.links()
    starts = lambda e: np.concatenate([[0], e[:-1]]) if len(e) else e
    assert sorted(zip(i.tolist(), j.tolist())) == [(p, q) for p in range(len(ends)) for q in range(len(other)) if starts(ends)[p] < other[q] and starts(other)[q] < ends[p]]


def test_a_long_run_is_jumped():
    got = cross_tokens.align(np.arange(1, 100_001), np.array([*range(1, 60_001), *range(60_002, 100_001)]))
    assert (got.run_a, got.run_b, got.run_n) == ([0, 60_002], [0, 60_001], [60_000, 39_998])
    assert (got.group_a, got.end_a, got.group_b, got.end_b) == ([60_000], [60_002], [60_000], [60_001])


def _documents():
    rng = random.Random(4)
    words = ["lorem", "ipsum", "Größe", "слово", "日本語", "\U0001f600", "don't", "x1234", "<s>", "<0x0A>", "<|endoftext|>", "naïve,", "hm...", "\x01", "a" * 90]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(25)]
    docs += [(100 + i, t) for i, t in enumerate(["line\none two\nthree", " lead", "trail ", "two  spaces", "a\n\nb", "tab\there", "nb sp", "▁", "one ▁two", "\n", " ", "▁x y", "a \nb", "\x00nul", "x"])]
    return docs + [(None, "lorem ipsum"), (-5, None), (-6, ""), (7, docs[0][1]), (7, docs[0][1]), (10**15, "lorem Größe слово " * 700 + "x")]


@pytest.mark.parametrize("block", [1, 300, cross_tokens.BLOCK])
def test_rows_equal_the_plain_version(spark, monkeypatch, block):
    docs = _documents()
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA).repartition(3)
    kept = cross_tokens.aligned
    monkeypatch.setattr(cross_tokens, "aligned", lambda documents, *files: kept(documents, *files, block=block))
    got = cross_tokens.linked(df, BYTE, PIECE)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain(docs)


def test_words_one_by_one_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(cross_tokens, "HALF", 20)  # both halves of the cache are used
    tokens = cross_tokens.BothTokenizers(BYTE, PIECE)
    texts = [t or "" for _, t in _documents()]
    for _ in range(2):
        for text in texts:
            want = [[i for i, _ in side] for side in _tokens(text)]
            assert [ids.tolist() for ids, _ in tokens.both([text])] == want
        (a, ends_a), (b, ends_b) = tokens.both(texts)  # together
        want = [_tokens(text) for text in texts]
        assert ends_a.tolist() == np.cumsum([len(x) for x, _ in want]).tolist() and a.tolist() == [i for x, _ in want for i, _ in x]
        assert ends_b.tolist() == np.cumsum([len(x) for _, x in want]).tolist() and b.tolist() == [i for _, x in want for i, _ in x]


def test_empty_table(spark):
    assert cross_tokens.linked(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).collect() == []
