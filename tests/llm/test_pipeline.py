"""The pipeline against plain Python, stage by stage in one go."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillcheck.llm import quality_rules
from quillcheck.llm.common import written
from tests.llm.fixtures import SCHEMA
from tests.llm.test_global_operators import PLAIN, plain_spans
from tests.llm.test_near_copies import plain_set

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus():
    rows = []
    for i in range(60):
        body = " ".join(f"{WORDS[(i * 7 + k * k) % 20]}{(i * 31 + k) % 97}x" for k in range(60 + i % 50))
        rows.append((i, f"{body}. Write to user{i}@mail.com or +1 (555) 010-99{i:02d}.", "en", f"s{i % 3}", 1))
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)]  # copies
    rows += [(200, "too short", "en", "s1", 1), (201, None, None, None, None), (202, "SHOUT! " * 80, "en", "s1", 1), (203, " ".join(f"w{k}" for k in range(6000)), "en", "s2", 1)]
    return rows


def redacted(text):
    spans = [s.split(":") for s in plain_spans(text).split(",") if s]
    for kind, a, b in sorted(spans, key=lambda s: -int(s[1])):
        text = f"{text[: int(a)]}[{kind.upper()}]{text[int(b) :]}"
    return text


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    failed = lambda t: (lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0] or 10 * m[2] > 3 * m[0] or 2 * m[6] > m[0] or 10 * m[7] > 3 * m[0])(quality_rules.measure(t))
    kept = [(r[0], r[1]) for r in rows if r[1] and not failed(r[1])]
    sets = [plain_set(t) for _, t in kept]
    root = list(range(len(kept)))
    for i, a in enumerate(sets):  # kept in ascending order of doc_id, so a root is the first of its component
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    left = [(d, redacted(t)) for k, (d, t) in enumerate(kept) if root[k] == k]
    assert {d for d, _ in left} == {*range(60), 203}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in left:
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        want.update((d, k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert set(PLAIN) >= {"email", "phone"}


def test_stages_keep_every_column_and_row_without_id(spark, tmp_path):
    rows = [(*r, i, f"x{i}", i, i) for i, r in enumerate([*corpus(), (None, corpus()[3][1] + " more words here", "en", None, 1), (None, None, "en", "s0", None), corpus()[7], (300, corpus()[8][1] + " and some words more", "en", "s9", 1)])]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, `a.b` int, node string, _quality int, rec int")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        docs = written(docs, name)
    left = docs.collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted([*range(60), 7, 203])  # 300 is a near copy; a repeated row stays
    assert [r["a.b"] for r in left if r["doc_id"] is None] == [69] and all(r["node"] == f"x{r['a.b']}" for r in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("doc_id is null").count() == 1


def test_stages_of_an_empty_table(spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0, name
