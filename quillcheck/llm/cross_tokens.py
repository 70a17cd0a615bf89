"""Alignment of two tokenizers' tokens of the same text, by diagonal run skipping, and counts of linked ids.

Both tokenizers' tokens cover the same bytes, so each gives an ascending array of end offsets. Where both
arrays have an end, a group ends. Most tokens are the same in both, at a fixed shift between the two
indices; so from a group's end the arrays are compared at the current shift over 1, 4, 8, 16, ... entries
until they differ, and the stretch up to there is taken as groups of one token each. The irregular group that follows is walked token by token up to the next common end, which sets the
next shift.

Documents are aligned in blocks of about BLOCK code points. A block keeps its different id pairs once,
with the number of its documents that hold each, and its documents' links as numbers into that list; so
a corpus-wide count takes one message a block and pair there and back, not one for each link.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for byte
has no tokens (all numbers 0, no groups); repeated rows are documents each; a null doc_id stays null; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.common import from_batches, written
from quillcheck.llm.token_ids import LONGEST, Encoder, has_other_space, has_uneven_space

#: Code points of a block (a longer text is a block of its own), and words in each half of the cache of both tokenizers.
BLOCK, HALF = 1 << 22, 200_000

_SPACE = "▁"
#: Words of old letters and signs, which all libraries class alike, and how a byte-level vocabulary cuts texts (fixed value).
_PLAIN = re.compile("\n?[!-~\u00a1-\u024f\u0400-\u045f]+")
_CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Alignment:
    """Groups and links of two token sequences, as flat lists.

    Runs: run_a[k], run_b[k], run_n[k], so many groups of one token each. All other groups: group k holds the tokens group_a[k]
    up to end_a[k] and group_b[k] up to end_b[k]. Links inside those others: link_a[k], link_b[k].
    """

    def __init__(self) -> None:
        self.run_a, self.run_b, self.run_n = [], [], []
        self.group_a, self.end_a, self.group_b, self.end_b = [], [], [], []
        self.link_a, self.link_b = [], []

    def n_groups(self) -> int:
        return sum(self.run_n) + len(self.group_a)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Token indices of all links: those of the runs, in order, then the others."""
        i, j, n, x, y = (np.array(c, np.int64) for c in (self.run_a, self.run_b, self.run_n, self.link_a, self.link_b))
        ends = np.cumsum(n)
        inside = np.arange(ends[-1] if len(n) else 0)
        return np.concatenate([inside + np.repeat(i - (ends - n), n), x]), np.concatenate([inside + np.repeat(j - (ends - n), n), y])


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """The alignment of two ascending arrays that end alike."""
    a, b = ends_a.astype("<u4").tobytes(), ends_b.astype("<u4").tobytes()
    at_a, at_b = ends_a.tolist(), ends_b.tolist()
    out = Alignment()
    run_a, run_b, run_n, link_a, link_b = out.run_a.append, out.run_b.append, out.run_n.append, out.link_a.append, out.link_b.append
    group_a, group_b, past_a, past_b, number = out.group_a.append, out.group_b.append, out.end_a.append, out.end_b.append, int.from_bytes
    i = j = 0
    n_a, n_b = len(at_a), len(at_b)
    while i < n_a:
        if at_a[i] == at_b[j]:
            p, q, most = 4 * i, 4 * j, 4 * min(n_a - i, n_b - j)
            same, step = 4, 16
            while same < most:
                step = min(step, most - same)
                x, y = a[p + same : p + same + step], b[q + same : q + same + step]
                if x != y:  # the lowest bit in which they differ tells the entry
                    differ = number(x, "little") ^ number(y, "little")
                    same += ((differ & -differ).bit_length() - 1) // 32 * 4
                    break
                same += step
                step *= 2
            n = same // 4
            run_a(i)
            run_b(j)
            run_n(n)
            i += n
            j += n
            if i == n_a:
                break
        group_a(i)
        group_b(j)
        end_a, end_b = at_a[i], at_b[j]
        link_a(i)
        link_b(j)
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = at_a[i]
            else:
                j += 1
                end_b = at_b[j]
            link_a(i)
            link_b(j)
        i += 1
        j += 1
        past_a(i)
        past_b(j)
    return out


class BothTokenizers(Encoder):
    """Ids of a space and a text by a byte-level vocabulary, and of the text by a piece vocabulary, word by word.

    No piece holds a space after another character, and none a line end, so words are encoded once, with the space or the
    line end before them. Texts with other white space, or more of it, are encoded whole.
    """

    def __init__(self, byte_file: str, piece_file: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        super().__init__(byte_file, True)
        self.pieces = SentencePieceProcessor(model_file=piece_file)
        spelled = {c: b for b, c in enumerate(self.characters)}
        size = self.tokenizer.get_vocab_size()
        self.bytes_a = [bytes(spelled[c] for c in t) if (t := self.tokenizer.id_to_token(i)) and all(c in spelled for c in t) else (t or "").encode() for i in range(size)]
        name = self.pieces.id_to_piece
        self.bytes_b = [bytes([int(name(i)[3:5], 16)]) if self.pieces.is_byte(i) else name(i).replace(_SPACE, " ").encode() for i in range(self.pieces.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        special = {self.tokenizer.id_to_token(i) for i in self.tokenizer.get_added_tokens_decoder()}
        ranks = {x: i for i, x in enumerate(self.bytes_a) if x and self.tokenizer.id_to_token(i) not in special}  # ids of such a vocabulary are in the order of its merges
        self.fast = Encoding("words", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})
        self.young_b: dict[str, bytes] = {}
        self.old_b: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def _same(self, text: str, a: bytes, b: bytes) -> bool:
        """Whether both tokenizers give back the text's bytes."""
        want = text.encode()
        return all(b"".join(map(table.__getitem__, array("I", ids))) == want for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def _all_same(self, spelled: list[bytes], table: list[bytes], sizes: np.ndarray, ids: bytes, ends: np.ndarray) -> bool:
        """As _same() for many words together: the bytes of all are theirs, and each ends where it should."""
        found = np.concatenate([[0], np.cumsum(sizes[np.frombuffer(ids, np.uint32)])])
        return bool((found[ends] == np.cumsum(list(map(len, spelled)))).all()) and b"".join(map(table.__getitem__, array("I", ids))) == b"".join(spelled)

    def _whole_b(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.pieces.encode(texts, num_threads=1)]

    def _learn_plain(self, words: list[str]) -> None:
        """Byte-level ids of plain words, all at once: no token reaches from one into the next."""
        spelled = [(w if w[0] == "\n" else f" {w}") for w in words]
        ids = np.array(self.fast.encode_ordinary("".join(spelled)), np.uint32)
        ends = np.searchsorted(np.cumsum(self.sizes_a[ids]), np.cumsum([len(x.encode()) for x in spelled])) + 1
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.young.update(zip(words, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def _learn_both(self, new: set[str]) -> None:
        fresh, plain, other = [], [], set()
        for w in new:
            if (x := self.old_b.get(w)) is not None:
                self.young[w], self.young_b[w] = self.old[w], x
            else:
                fresh.append(w)
                plain.append(w) if _PLAIN.fullmatch(w) else other.add(w)
        if not fresh:
            return
        self._learn(other)
        if plain:
            self._learn_plain(plain)
        found = [ids[1:] if w[0] == "\n" else ids for w, ids in zip(fresh, self.pieces.encode(fresh, num_threads=1))]  # after a line end no space is added
        ends = np.cumsum(list(map(len, found)))
        b = array("I", chain.from_iterable(found)).tobytes()
        self.young_b.update(zip(fresh, [b[4 * i : 4 * j] for i, j in zip([0, *ends.tolist()], ends.tolist())]))
        spelled = [(w if w[0] == "\n" else f" {w}").encode() for w in fresh]
        of_a = [self.young[w] for w in fresh]
        if self._all_same(spelled, self.bytes_b, self.sizes_b, b, ends) and self._all_same(spelled, self.bytes_a, self.sizes_a, b"".join(of_a), np.cumsum(list(map(len, of_a))) // 4):
            return
        self.lossy.update(w for w, x, a in zip(fresh, spelled, of_a) if not self._same(x.decode(), a, self.young_b[w]))

    def both(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either tokenizer (ids of all texts one after the other, where each text's ids end); no ids where a text has no tokens."""
        split = [[] if not text or has_other_space(text) or has_uneven_space(text) else text.replace("\n", " \n").split(" ") for text in texts]
        words = set().union(*split)
        self._learn_both(words.difference(self.young))
        known, of_a, of_b = list(words), list(map(self.young.__getitem__, words)), list(map(self.young_b.__getitem__, words))
        if self.lossy and not self.lossy.isdisjoint(words):
            split = [[] if not self.lossy.isdisjoint(w) else w for w in split]
        place = dict(zip(known, range(len(known))))
        sizes = list(map(len, split))
        order = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        ends = np.cumsum(sizes)
        for i, text in enumerate(texts):  # a whole text is a word of its own
            if text and not split[i] and (has_other_space(text) or has_uneven_space(text)):
                a, b = self.whole([f" {text}"])[0], self._whole_b([text])[0]
                if self._same(f" {text}", a, b):
                    order = np.insert(order, ends[i], len(of_a))
                    ends[i:] += 1
                    of_a.append(a)
                    of_b.append(b)
        if len(self.young) > HALF:
            short = lambda d: {w: x for w, x in d.items() if len(w) <= LONGEST}
            self.young, self.old, self.young_b, self.old_b = {}, short(self.young), {}, short(self.young_b)
            self.lossy.intersection_update(self.old)
        return [_gathered(x, order, ends) for x in (of_a, of_b)]


def _gathered(of_words: list[bytes], order: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words in this order, and how many there are up to each of the ends."""
    ids = np.frombuffer(b"".join(of_words), np.uint32)
    n = np.array(list(map(len, of_words)), np.int64) // 4
    starts, n = (np.cumsum(n) - n)[order], n[order]
    up_to = np.cumsum(n)
    places = np.repeat(starts - (up_to - n), n) + np.arange(up_to[-1] if len(n) else 0)
    return ids[places], np.concatenate([[0], up_to])[ends]


_tokenizers: dict[tuple[str, str], BothTokenizers] = {}


def tokenizers(byte_file: str, piece_file: str) -> BothTokenizers:
    """The worker's pair of tokenizers, kept between tasks."""
    if (byte_file, piece_file) not in _tokenizers:
        _tokenizers[byte_file, piece_file] = BothTokenizers(byte_file, piece_file)
    return _tokenizers[byte_file, piece_file]


def group_text(a: np.ndarray, b: np.ndarray, found: Alignment, single: list[str]) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group, in order. single: the texts of the groups of one token each."""
    of_a, of_b = a.tolist(), b.tolist()
    parts: list[str] = []
    k = at = 0
    for i, end, j, end_b in zip(found.group_a, found.end_a, found.group_b, found.end_b):
        if k < len(found.run_a) and found.run_a[k] < i:
            parts += single[at : at + found.run_n[k]]
            at += found.run_n[k]
            k += 1
        parts.append(f"{','.join(map(str, of_a[i:end]))}|{','.join(map(str, of_b[j:end_b]))}")
    parts += single[at:]
    return ";".join(parts)


ALIGNED = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>,"
    " pairs array<long>, docs_with array<int>, ends array<int>, numbers binary, times binary"
)
ALIGNED_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]


def aligned(documents: DataFrame, byte_file: str, piece_file: str, block: int = BLOCK) -> DataFrame:
    """One row for each block of documents.

    pairs: its different id pairs (a << 32 | b), those that most documents hold first; docs_with: how many of its documents hold
    each. numbers and times: for each document, up to its end in ends, the pairs it holds and how often, unsigned 32-bit.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = tokenizers(byte_file, piece_file), TaskContext.get().partitionId() << 32
        number = size = 0

        def made(doc_ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            (ids_a, ends_a), (ids_b, ends_b) = tokens.both(texts)
            bytes_a, bytes_b = np.cumsum(tokens.sizes_a[ids_a]), np.cumsum(tokens.sizes_b[ids_b])
            found: list[Alignment] = []
            codes, singles = [np.empty(0, np.int64)], []
            i = j = 0
            for end, end_b in zip(ends_a.tolist(), ends_b.tolist()):
                found.append(align(bytes_a[i:end], bytes_b[j:end_b]))
                x, y = found[-1].links()
                codes.append(ids_a[i:end][x].astype(np.int64) << 32 | ids_b[j:end_b][y])
                singles.append(sum(found[-1].run_n))
                i, j = end, end_b
            n_links = np.array([len(c) for c in codes[1:]], np.int64)
            pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
            held, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * len(pairs) + place, return_counts=True)
            each, held_ends = held % max(1, len(pairs)), np.searchsorted(held, (np.arange(len(texts)) + 1) * len(pairs))
            names = [f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()]
            digests, i, j, at = [], 0, 0, 0
            for k, (end, end_b) in enumerate(zip(ends_a.tolist(), ends_b.tolist())):
                single = list(map(names.__getitem__, place[at : at + singles[k]].tolist()))
                digests.append(hashlib.sha256(group_text(ids_a[i:end], ids_b[j:end_b], found[k], single).encode()).hexdigest() if end > i else "")
                i, j, at = end, end_b, at + int(n_links[k])
            docs_with = np.bincount(each, minlength=len(pairs))
            by_count = np.argsort(-docs_with, kind="stable")
            rank = np.empty(len(pairs), "<u4")
            rank[by_count] = np.arange(len(pairs))
            lists = [doc_ids, np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0), [x.n_groups() for x in found], digests, pairs[by_count], docs_with[by_count], held_ends]
            columns = [[base + number], *([c] for c in lists), [rank[each].tobytes()], [times.astype("<u4").tobytes()]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, *[pa.binary()] * 2]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=ALIGNED_NAMES)

        doc_ids: list[int | None] = []
        texts: list[str] = []
        for batch in batches:
            for doc_id, text in zip(from_batches(batch, "doc_id"), from_batches(batch, "text")):
                doc_ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if size > block:
                    yield made(doc_ids, texts)
                    doc_ids, texts, size, number = [], [], 0, number + 1
        if doc_ids:
            yield made(doc_ids, texts)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(blocks, ALIGNED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair of ids is linked, and whether no other pair of its first id is in more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "docs_with")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs_with").alias("n"))
    counts = written(each, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(documents: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    blocks = written(aligned(documents, byte_file, piece_file), "alignments", compression="zstd")
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(blocks), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("answers"))  # as many as the block has pairs

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                of = lambda c: batch.column(batch.schema.get_field_index(c))[r]  # noqa: E731,B023
                ends = np.array(of("ends").as_py(), np.int64)
                numbers, times = (np.frombuffer(of(c).as_py(), "<u4").astype(np.int64) for c in ("numbers", "times"))
                count, best = (np.array(of(c).values.to_numpy(zero_copy_only=False) if of(c).is_valid else [], np.int64) for c in ("counts", "bests"))
                per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: E731,B023
                own = [of(c).values for c in ("doc_ids", "n_a", "n_b", "n_groups")]
                sums = [pa.array(per(x)) for x in (times, times * best[numbers], times * count[numbers])]
                yield pa.RecordBatch.from_arrays([*own, *sums, of("groups_sha256").values], names=names)

    kept = blocks.drop("pairs", "docs_with").join(answers, "block", "left")
    return kept.select("doc_ids", "n_a", "n_b", "n_groups", "groups_sha256", "ends", "numbers", "times", F.col("answers.n").alias("counts"), F.col("answers.best").alias("bests")).mapInArrow(summed, schema)
