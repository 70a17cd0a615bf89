"""Quality rules, media columns and token ids against plain Python."""

import hashlib
import io
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillcheck.llm import media, packing, quality_rules, repair_shards, token_ids
from tests.llm.fixtures import documents, edge_rows


def plain_measures(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality(spark):
    got = quality_rules.judged(documents(spark)).collect()
    want = Counter()
    for doc_id, text, *_ in edge_rows():
        n, *rest = plain_measures(text)
        want[doc_id, n, *rest, n < 50 or 100 * rest[-1] > 50 * n] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality_rules.kept_documents(documents(spark))
    assert kept.columns == documents(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.judged(documents(spark, [])).count() == 0


def test_ablations(spark):
    rows = quality_rules.ledger(documents(spark)).collect()
    bit = {r: quality_rules.mask((r,)) for r in quality_rules.RULES}
    whole = quality_rules.mask(quality_rules.POLICIES["v2"])
    got = {r.rule: (r.n_failed, r.n_only_this_rule) for r in quality_rules.ablations(quality_rules.ledger(documents(spark)), "v2").collect()}
    for rule, b in bit.items():
        failed = sum(bool(r.fail_bits & b) for r in rows)
        if failed:
            assert got[rule] == (failed, sum(r.fail_bits & whole == b for r in rows))


def test_media(spark):
    stored = media.encode(documents(spark))
    files = Counter()
    for r in stored.collect():
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
            files[r.doc_id, r.n_bytes, w.readframes(w.getnframes())] += 1
    want = Counter()
    for doc_id, text, *_ in edge_rows():
        data = (text or "").encode()
        want[doc_id, len(data), data + b" " * (-len(data) % 192 if data else 192)] += 1
    assert files == want
    got = media.features(stored).select("*", media.feature_text().alias("feature")).collect()
    payloads = {hashlib.sha256(p).hexdigest(): p for _, _, p in want}
    by_payload = {}
    for r in got:
        p = payloads[r.payload_sha256]
        assert (r.payload_bytes, r.tail_crc32, len(r.fp_time)) == (len(p), zlib.crc32(p[-16:]), len(r.fp_code))
        assert r.fp_time == sorted(r.fp_time)
        assert by_payload.setdefault(p, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.features(media.encode(documents(spark, []))).count() == 0


def test_fingerprint_follows_the_tone():
    t = np.arange(8000) / 8000
    tone = (128 + 90 * np.sin(2 * np.pi * 1000 * t) * (1 + 0.3 * np.sin(2 * np.pi * 9 * t))).astype(np.uint8)
    _, codes = media.fingerprint(tone)
    heard = Counter(f for f in (codes >> 13).tolist() if media.BANDS[1][0] <= f < media.BANDS[1][1])
    assert heard.most_common(1)[0][0] == 24  # 1000 Hz of 8000 in a frame of 192


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_are_those_of_whole_texts(name, spaces):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    odd = ["a  b\n\n c d\te", " x", "x ", "\n\n", "", "don't stop\n 's <|endoftext|> a<|endoftext|>b", "é́ ´", "ΑΣ ΑΣ", "a b    c", "12 3456", "a\x01b c\x01 d", "a\r\nb c", "\x01", "x\x01", "Straße, ÉTÉ!? naïve... don't; a,b µm ªx ×y ÿ Ɏ.", "word.\nNext, (x) it's I'll, we've: A.B"]
    every = [t or "" for _, t, *_ in edge_rows()] + odd
    tokens = token_ids.Encoder(path, spaces)
    for _ in range(2):
        assert tokens.ids(every) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(every, add_special_tokens=False)]


def encoded(name, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    return [(d, whole.encode(t or "", add_special_tokens=False).ids + [end]) for d, t, *_ in edge_rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repair_shards(spark):
    shards = repair_shards.write_shards(documents(spark), public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=2_000)
    per_task = Counter(r["shard"] >> 32 for r in shards.collect())
    assert max(per_task.values()) > 2
    got = repair_shards.read_back(shards).collect()
    want = encoded("byte_bpe_50k.json", 2)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in want)
    got.sort(key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    by_id = {d: i for d, i in want if d is not None}
    for row in shards.collect():
        shard = repair_shards.Shard(row.asDict())
        for i, d in enumerate(shard.doc_ids):
            if d is not None:
                assert shard.document(i).tolist() == by_id[d]
    assert repair_shards.read_back(repair_shards.write_shards(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_repair_rules_compress_and_expand():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50_000, 40), 200)
    base, rules, rounds, lengths, sequence = repair_shards.compress(ids)
    assert (repair_shards.expand(sequence, base, rules) == ids).all()
    assert len(sequence) + 2 * len(rules) < len(ids) / 10
    assert all(lengths[i] == len(repair_shards.expand(np.array([base + i], np.uint32), base, rules)) for i in range(len(rules)))
    same = repair_shards.compress(np.full(1001, 5))
    assert repair_shards.expand(same[4], same[0], same[1]).tolist() == [5] * 1001


def plain_pairs(sequence):
    """How often each pair of neighbours occurs, without overlaps."""
    counts, last = Counter(), {}
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        if pair[0] != pair[1] or last.get(pair) != i - 1:
            counts[pair] += 1
            last[pair] = i
    return counts


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 3), (2, 1), (7, 1), (100, 1), (4000, 2), (9000, 40), (9000, 3000)])
def test_repair_goes_on_until_no_pair_is_frequent(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.concatenate([rng.integers(0, kinds, n), np.tile(rng.integers(0, kinds, min(n, 300)), 40)])
    base, rules, rounds, lengths, sequence = repair_shards.compress(ids)
    assert (repair_shards.expand(sequence, base, rules) == ids).all()
    assert max(plain_pairs(sequence.tolist()).values(), default=0) < repair_shards.MIN_COUNT
    assert sum(rounds) == len(rules) == len(lengths)
    assert n < 300 or lengths.max() > 16  # long repeats become one symbol or a few


def test_the_most_frequent_pair_goes_first():
    ids = np.array([1, 2, 3] * 4 + [2, 3] * 5 + [9, 1, 2] * 3)
    base, rules, *_ = repair_shards.compress(ids)
    assert rules[0].tolist() == [2, 3]


def test_packing(spark):
    got = packing.pack(documents(spark), public_tokenizers.path("word_bpe_49k.json"), 4096).collect()
    want = Counter()
    for d, ids in encoded("word_bpe_49k.json", 1):
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1 + -(-sum(r.length for r in got) // 4096)
    assert packing.pack(documents(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_two_smaller_pieces_replace_the_smallest():
    patterns = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert patterns[0] == (1, {6: 1, 2: 2})  # 6 + 3 leaves one; two pieces of 2 fill the gap of 4
    assert sum(often for often, _ in patterns) == 2
