"""A level of an n-gram trie in Elias-Fano sequences, kept in one memory-mapped file.

The contexts (64-bit keys) are a monotone sequence, and a second one points from each context to the
range of its successors. The successors are word ids, ascending inside a range, each with the last
value of the range before added to it, so that all ranges together are monotone too; a search for a
word runs inside its context's range, for the word's id relative to the value before that range.
Beside each successor stands the code of its smoothed probability, one byte on a logarithmic scale.
"""

from __future__ import annotations

import json
import tempfile

import numpy as np

#: Every so many elements of a sequence the place of its upper bits is noted.
SAMPLE = 4096
#: Queries that are searched together.
QUERIES = 1 << 16
LEVELS = 254


class EliasFano:
    """A monotone sequence of unsigned integers: lower bits in whole bytes, upper bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, places: np.ndarray, n: int, shift: int):
        self.low, self.high, self.places, self.n, self.shift = low, high, places, n, shift

    @classmethod
    def parts(cls, values: np.ndarray) -> dict[str, np.ndarray]:
        """values: ascending uint64."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        shift = 8 * max(0, ((top // max(n, 1)).bit_length() + 3) // 8)  # lower bits fill whole bytes
        width = shift // 8
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]) if n else np.empty((0, width), np.uint8)
        upper = (values >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(n, np.int64)
        ones = upper + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return {"low": low.reshape(-1), "high": np.packbits(bits), "places": ones[::SAMPLE].astype("<u8"), "meta": np.array([n, shift], "<u8")}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        n, shift = parts["meta"].tolist()
        return cls(parts["low"], parts["high"], parts["places"], n, shift)

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Elements start to stop; only their part of the sequence is read."""
        first = start // SAMPLE
        begin = int(self.places[first]) if start < stop else 0
        last = -(-stop // SAMPLE)
        end = int(self.places[last]) if last < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)])
        ones = np.flatnonzero(bits[begin % 8 :])[start - first * SAMPLE : stop - first * SAMPLE] + begin
        upper = (ones - np.arange(start, stop)).astype(np.uint64)
        width = self.shift // 8
        low = np.zeros((stop - start, 8), np.uint8)
        low[:, :width] = self.low[start * width : stop * width].reshape(stop - start, width)
        return (upper << np.uint64(self.shift) if self.shift < 64 else 0) | low.view("<u8").reshape(-1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each of wanted (ascending), or -1; one part of the sequence is decoded at a time."""
        found = np.full(len(wanted), -1, np.int64)
        at = 0
        for start in range(0, self.n, SAMPLE):
            if at >= len(wanted):
                break
            values = self.decode(start, min(self.n, start + SAMPLE))
            to = at + int(np.searchsorted(wanted[at:], values[-1], "right"))
            if to > at:
                place = np.searchsorted(values, wanted[at:to])
                hit = values[np.minimum(place, len(values) - 1)] == wanted[at:to]
                found[at:to] = np.where(hit, start + place, -1)
                at = to
        return found


class Trie:
    """Built from arrays, then held in an unlinked memory-mapped file of the task's own."""

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, words: np.ndarray, probability: np.ndarray):
        """contexts: ascending keys; pointers: where each one's successors begin, and the end; words: ids, ascending for each context."""
        least = float(np.log10(probability.min(initial=1.0)))
        self.least, self.step = least, -least / LEVELS or 1.0
        codes = np.floor((np.log10(probability) - least) / self.step + 1e-9)  # rounded down, so that no context's sum exceeds one
        sizes = np.diff(pointers)
        last = np.zeros(len(contexts), np.uint64)
        last[sizes > 0] = words[pointers[1:][sizes > 0] - 1]
        successors = words.astype(np.uint64) + np.repeat(np.cumsum(last) - last, sizes)
        arrays = {f"{name}.{k}": v for name, values in (("contexts", contexts), ("pointers", pointers), ("successors", successors)) for k, v in EliasFano.parts(values.astype(np.uint64)).items()}
        arrays["codes"] = np.clip(codes, 0, LEVELS).astype(np.uint8) + np.uint8(1)
        self._map(arrays)

    def _map(self, arrays: dict[str, np.ndarray]) -> None:
        places, at = {}, 0
        with tempfile.TemporaryFile() as file:
            for name, a in arrays.items():
                at += -at % 8
                places[name] = (at, a.dtype.str, a.nbytes)
                file.seek(at)
                file.write(a.tobytes())
                at += a.nbytes
            file.write(json.dumps(places).encode())
            file.flush()
            self.file = np.memmap(file, np.uint8, "r")
        views = {name: self.file[a : a + n].view(kind) for name, (a, kind, n) in places.items()}
        self.contexts, self.pointers, self.successors = (EliasFano.of({k.partition(".")[2]: v for k, v in views.items() if k.startswith(f"{name}.")}) for name in ("contexts", "pointers", "successors"))
        self.codes = views["codes"]

    def rank(self, contexts: np.ndarray) -> np.ndarray:
        """Rank of each context (ascending hashes), or -1."""
        return self.contexts.find(contexts)

    def places(self, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each word (ascending for a rank) among the successors of its context (ranks ascend, -1: none), or -1."""
        out, known = np.full(len(rank), -1, np.int64), np.flatnonzero(rank >= 0)
        for part in (known[at : at + QUERIES] for at in range(0, len(known), QUERIES)):
            r, w = rank[part], word[part].astype(np.uint64)
            pointers = self.pointers.decode(int(r[0]), int(r[-1]) + 2).astype(np.int64)
            low, stop = pointers[r - r[0]], pointers[r - r[0] + 1]
            first = max(int(low[0]) - 1, 0)
            values = self.successors.decode(first, int(stop[-1]))
            if not len(values):
                continue
            low, stop = low - first, stop - first
            wanted = w + np.where(low + first > 0, values[np.maximum(low - 1, 0)], np.uint64(0))
            high, open_ = stop.copy(), np.flatnonzero(low < stop)
            while len(open_):  # a binary search in all ranges at once
                middle = (low[open_] + high[open_]) >> 1
                less = values[middle] < wanted[open_]
                low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
                open_ = open_[low[open_] < high[open_]]
            hit = (low < stop) & (values[np.minimum(low, len(values) - 1)] == wanted)
            out[part[hit]] = low[hit] + first
        return out

    def probability(self, context: int, word: int) -> float:
        """One query; zero where the trie has none."""
        place = int(self.places(self.rank(np.array([context], np.uint64)), np.array([word], np.uint64))[0])
        return float(10 ** (self.least + self.step * (int(self.codes[place]) - 1))) if place >= 0 else 0.0
