"""Token ids of whole texts by the tokenizers library, with a bounded cache of encoded words.

Both vocabularies used here never form a token across the place between a visible character and a
following space or line end, so a text's ids are those of its words, each with the spaces before it,
one after the other. Frequent words are encoded once in each worker. A text with any other white
space is encoded by the library in one piece. tests/llm compares both ways.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa

from quillcheck.llm.common import from_batches

WORD = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Words in each of the two halves of the cache, and the longest word kept in it: some 140 MB in all.
HALF, LONGEST = 400_000, 64
#: Stands before a text's first word in the cache's keys, where a space is understood otherwise. No text with it gets there.
FIRST = "\r"
#: A control character whose last id no other character has; it parts words that are encoded together.
MARK = "\x01"
#: Words that are one letter pretoken, and signs after it that are another: the model encodes them without the rest of the tokenizer.
LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:]*)")
ASCII_LETTERS = re.compile("([A-Za-z]+)([.,!?;:]*)")
#: Code points of texts that are looked up together.
GROUP = 1 << 19


def has_other_space(text: str) -> bool:
    """Whether a text has white space other than spaces and line ends."""
    return any(c in text for c in ASCII_SPACE) if text.isascii() else OTHER_SPACE.search(text) is not None


def has_uneven_space(text: str) -> bool:
    """Whether spaces or line ends stand at an end of a text or next to each other."""
    return not text or text[0] in " \n" or text[-1] in " \n" or any(two in text for two in ("  ", " \n", "\n ", "\n\n"))


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Encoder:
    """ids(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, spaces: bool):
        """spaces: whether white space becomes part of tokens (else the tokenizer drops it)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaces = spaces
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.mark: int | None = None
        self.model, self.signs, self.id = self.tokenizer.model, {"": b""}, attrgetter("id")
        self.characters = byte_characters()
        self.blank = self.characters[ord(" ")]  # printable ASCII characters stand for themselves
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def parted(self, words: list[str]) -> list[bytes]:
        """As whole(), for words that may stand in one text, with MARK as a word of its own between them."""
        if self.mark is None:
            mark = self.encode([f" {MARK}"], add_special_tokens=False)[0].ids
            self.mark, self.width = mark[-1], len(mark)
        ids = np.array(self.encode([f" {MARK}".join([*words, ""]) if self.spaces else f" {MARK} ".join([*words, ""])], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(ids == self.mark) + 1
        if len(ends) != len(words):  # a word has the mark in it
            return self.whole(words)
        data, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        return [data[4 * i : 4 * (j - self.width)] for i, j in zip(starts, ends.tolist())]

    def pretoken(self, text: str) -> bytes:
        """Ids of a text that is one pretoken, by the model alone."""
        if not self.spaces:
            return array("I", map(self.id, self.model.tokenize(text.lower()))).tobytes()
        spelled = self.blank + text[1:] if text[0] == " " and text.isascii() else "".join(map(self.characters.__getitem__, text.encode()))
        return array("I", map(self.id, self.model.tokenize(spelled))).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        found: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if has_other_space(text):
                found[i] = self.whole([text])[0]
            elif not self.spaces:
                split.append((i, [w for w in text.replace("\n", " ").split(" ") if w]))
            elif has_uneven_space(text):
                found[i] = b"".join(self.whole(WORD.findall(text)))
            else:
                words = text.replace("\n", " \n").split(" ")
                words[0] = FIRST + words[0]
                split.append((i, words))
        self._learn(set().union(*(w for _, w in split)).difference(self.young))
        known = self.young.__getitem__
        for i, words in split:
            found[i] = b"".join(map(known, words))
        if len(self.young) > HALF:
            self.young, self.old = {}, {w: x for w, x in self.young.items() if len(w) <= LONGEST}
        return found

    def _learn(self, new: set[str]) -> None:
        firsts, rest = [], []
        shape, blank = (LETTERS if self.spaces else ASCII_LETTERS).fullmatch, self.blank if self.spaces else ""
        young, old, tokenize, number = self.young, self.old.get, self.model.tokenize, self.id
        for w in new:
            if (x := old(w)) is not None:
                young[w] = x
            elif w.isalpha() and w.isascii():  # most words
                young[w] = array("I", map(number, tokenize(blank + w if blank else w.lower()))).tobytes()
            elif w[0] == FIRST:
                firsts.append(w)
            elif (m := shape(w)) is None:
                rest.append(w)
            else:
                letters, signs = m.groups()
                if signs not in self.signs:
                    self.signs[signs] = self.pretoken(signs)
                young[w] = self.pretoken(f" {letters}" if self.spaces else letters) + self.signs[signs]
        if firsts:
            self.young.update(zip(firsts, self.whole([w[1:] for w in firsts])))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            self.young.update(zip(part, self.parted([w if w[0] == "\n" else f" {w}" for w in part] if self.spaces else part)))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder of a tokenizer file, kept between tasks."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]


def encoded(batches: Iterator[pa.RecordBatch], path: str, spaces: bool) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) for each row with columns doc_id and text, in order; a null text is an empty one."""
    tokens = encoder(path, spaces)
    doc_ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(from_batches(batch, "doc_id"), from_batches(batch, "text")):
            doc_ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size > GROUP:
                yield from zip(doc_ids, tokens.ids(texts))
                doc_ids, texts, size = [], [], 0
    yield from zip(doc_ids, tokens.ids(texts))
