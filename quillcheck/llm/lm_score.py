"""Language-model scores from sharded Elias-Fano n-gram tries of three orders.

The model interpolates trigrams, bigrams and the unigram base by absolute discounting:

    p(w | a b) = (count(a b w) - DISCOUNT) / count(a b) + DISCOUNT * successors(a b) / count(a b) * p(w | b)
    p(w | b)   = (count(b w) - DISCOUNT) / count(b) + DISCOUNT * successors(b) / count(b) * base(w)

without the first terms where they are not positive, and p(w | b) alone for a context that training
does not have. The first terms are what the tries store, one byte an n-gram;
base(w) = (count(w) + 0.1) / (N + 0.1 (V + 1)). A text's first word follows the end of a text, in
a trigram context of its own.

1. Texts become blocks of about BLOCK_TOKENS tokens: word hashes, and the tokens as local codes.
2. Word counts: each block sends its training counts by shards of the hash, and is sent back the
   total and the id of every word that it has. From here on words are known by their ids.
3. Bigrams: each block sends its distinct bigrams, training counts with them, by shards of the
   context. A context's number of shards follows from its count, so that frequent ones are spread.
   A shard adds up the counts, builds its level of the trie and sends each block the code, the count
   and the place of its bigrams.
4. Trigrams: the same, with the place of a bigram in its level as the context's key. Contexts that
   training does not have are not asked for.
5. Blocks sum up their documents.

Words are told apart by 64-bit hashes, everything above them by exact ids. All is counted over all
training documents; nothing is pruned. What a task holds is one block, or a shard, whose number
follows the input. A block and a shard exchange a message only if they share a context, at most
blocks x shards of them: fewer than the tokens up to BLOCK_TOKENS x SHARD_TOKENS of these (one
million million), beyond which both sizes should grow. Blocks, and the replies to each in one row, are
bucketed by block, so they are joined without a shuffle each time that they are read.

Defined results: a null text is an empty one, scored by its end; a null doc_id counts as training;
repeated rows count and are scored each; an empty table gives an empty result; without training
documents both scores are those of the base. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.common import bucketed, from_batches, written
from quillcheck.llm.ef_trie import Trie

HELD_OUT = 10
DISCOUNT, ADD = 0.75, 0.1
BLOCK_TOKENS, SHARD_WORDS, SHARD_TOKENS = 1_000_000, 1_000_000, 1_000_000
#: A context is spread over one shard for each so many parts of a shard's tokens.
SPREAD = 4
END = 0  # local code of the end of a text, whose hash is that of the empty word
#: Key of the context of first words; keys of bigrams are greater. Marks keys that are sent whole.
FIRST, WHOLE = 0, np.uint64(1 << 62)

BLOCKS = "block long, n_tokens long, n_words long, doc_ids binary, null_ids binary, held binary, sizes binary, hashes binary, codes binary"
WORDS = "shard long, block long, hashes binary, counts binary"
TOTALS = "block long, shard long, data binary, more binary, places binary, counts binary, n long, v long"
GRAMS = "shard long, block long, contexts binary, totals binary, runs binary, words binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in schema.split(", ")])


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte by byte: the upper bytes of small ones are zeros, which pack to nothing."""
    return _packed(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _steps(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Index(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _blocks(block_tokens: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        schema = _arrow(BLOCKS)
        index, codes, sizes, ids, held, n = _Index({b"": END}), [], [], [], [], 0

        def block() -> pa.RecordBatch:
            hashes, every = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)), np.concatenate(codes)
            counts = np.bincount(every, minlength=len(index))
            counts[END] = n + 1  # stays first
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(index), "<u4")
            rank[order] = np.arange(len(index))
            row = {"block": next(number), "n_tokens": n, "n_words": len(index), "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "null_ids": np.array([k for k, i in enumerate(ids) if i is None], "<u4").tobytes(), "held": np.array(held, np.uint8).tobytes(), "sizes": np.array(sizes, "<u4").tobytes(), "hashes": hashes[order].tobytes(), "codes": _planes(rank[every])}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc_id, text, out in zip(from_batches(batch, "doc_id"), from_batches(batch, "text"), from_batches(batch, "held")):
                words = (text or "").encode().lower().split()
                words.append(b"")
                codes.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                sizes.append(len(words))
                ids.append(doc_id)
                held.append(out)
                n += len(words)
                if n >= block_tokens:
                    yield block()
                    index, codes, sizes, ids, held, n = _Index({b"": END}), [], [], [], [], 0
        if ids:
            yield block()

    return each


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, as (contexts, words), and the number of each token's pair."""
    low, place = int(word.max()).bit_length(), (len(word) - 1).bit_length()
    if int(context.max()).bit_length() + low + place > 63:
        pairs, of = np.unique(context << 32 | word, return_inverse=True)
        return pairs >> 32, pairs & 0xFFFFFFFF, of
    both = np.sort((context << low | word) << place | np.arange(len(word)))  # each with its place, so that one plain sort does
    pairs = both >> place
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    of = np.empty(len(pairs), np.int64)
    of[both & ((1 << place) - 1)] = np.cumsum(new) - 1
    pairs = pairs[new]
    return pairs >> low, pairs & ((1 << low) - 1), of


class Block:
    """One row of the blocks, unpacked."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.hashes, self.sizes = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        nulls = set(np.frombuffer(row["null_ids"], "<u4").tolist())
        self.doc_ids = [None if k in nulls else i for k, i in enumerate(np.frombuffer(row["doc_ids"], "<i8").tolist())]
        self.codes = _from_planes(row["codes"]).astype(np.int64)
        self.train = np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def word_order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Words by shard, and where each shard's begin, with the end."""
        shard = self.hashes % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def learn_words(self, replies: list[dict], shards: int) -> None:
        """Sets counts (training counts in the whole corpus) and ids of the words; codes become ranks of ids."""
        order, at = self.word_order(shards)
        counts, ids = np.zeros(len(self.hashes), np.int64), np.zeros(len(self.hashes), np.uint64)
        for r in replies:
            words = order[at[r["shard"]] : at[r["shard"] + 1]]
            counts[words] = _unpacked(r["data"], "<i8")
            ids[words] = _from_planes(r["more"]) * np.uint64(shards) + np.uint64(r["shard"])
        by = np.argsort(ids)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.end, self.codes, self.counts, self.ids = int(rank[END]), rank[self.codes], counts[by], ids[by]

    def bigrams(self, n_tokens: int, shards: int) -> Grams:
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.starts] = self.end  # a first word follows the end of a text
        return Grams(before, self.codes, self.ids, self.counts, self.ids, n_tokens, shards)

    def trigrams(self, bigrams: Grams, replies: list[dict] | None, n_tokens: int, shards: int) -> Grams:
        """The context of a token is the bigram that ends before it."""
        counts, keys = bigrams.known(replies, shards)
        by = np.argsort(keys, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(1, len(by) + 1)
        context = np.empty_like(self.codes)
        context[1:] = rank[bigrams.of_token[:-1]]
        context[self.starts] = 0
        totals = np.concatenate([self.counts[self.end : self.end + 1], counts[by]])  # as many first words as ends
        return Grams(context, self.codes, np.concatenate([np.array([FIRST], np.uint64), keys[by]]), totals, self.ids, n_tokens, shards)


class Grams:
    """A block's distinct n-grams of one order (context, word), and how they are sent to shards.

    keys: of contexts, ascending where totals (their training counts) are positive; ids: of words, ascending.
    """

    def __init__(self, context_of: np.ndarray, word_of: np.ndarray, keys: np.ndarray, totals: np.ndarray, ids: np.ndarray, n_tokens: int, shards: int):
        self.context, self.word, self.of_token = _distinct(context_of, word_of)
        self.totals, self.keys, self.ids = totals, keys, ids
        sent = np.flatnonzero((totals > 0)[self.context])
        fan = 1 + (totals * SPREAD * shards // max(n_tokens, 1)).clip(0, shards - 1)
        home = (keys % np.uint64(shards)).astype(np.int64)
        # a shard tells its own contexts apart by their quotients, and contexts that are spread by their whole keys
        self.sent_keys = np.where(fan > 1, keys | WHOLE, keys // np.uint64(shards))
        context = self.context[sent]
        shard, spread = home[context], (fan > 1)[context]
        wide = np.flatnonzero(spread)
        turn = (_mixed(ids[self.word[sent[wide]]]) >> np.uint64(8)).astype(np.int64) % fan[context[wide]]
        shard[wide] = (shard[wide] + turn) % shards
        slot = shard * 2 + spread
        by = np.argsort(slot.astype(np.uint16) if shards < 1 << 15 else slot, kind="stable")
        self.order, slot, context = sent[by], slot[by], context[by]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (context[1:] != context[:-1])
        new = np.flatnonzero(new)
        head, run = slot[new] << 32 | context[new], np.diff(np.append(new, len(slot)))
        # a spread context asks all its shards for its successors there, also those it has no n-gram for
        spread = np.zeros(len(fan), bool)
        spread[self.context[sent[wide]]] = True
        spread = np.flatnonzero(spread)
        every = np.repeat(spread, fan[spread])
        turn = np.arange(len(every)) - np.repeat(np.cumsum(fan[spread]) - fan[spread], fan[spread])
        asked = np.unique(((home[every] + turn) % shards * 2 + 1) << 32 | every)
        at = np.searchsorted(head, asked)
        absent = head[np.minimum(at, len(head) - 1)] != asked if len(head) else np.ones(len(asked), bool)
        asked, at = asked[absent], at[absent]
        head, self.head_run = np.insert(head, at, asked), np.insert(run, at, 0)
        self.head_context, head_shard = head & 0xFFFFFFFF, head >> 33
        self.shards = np.unique(head_shard)
        self.at = np.searchsorted(slot >> 1, np.append(self.shards, shards))
        self.head_at = np.searchsorted(head_shard, np.append(self.shards, shards))

    def parts(self) -> Iterator[tuple[int, np.ndarray, slice]]:
        """For each shard that is asked: its number, the n-grams it has, and its heads (contexts)."""
        for k, s in enumerate(self.shards.tolist()):
            yield s, self.order[self.at[k] : self.at[k + 1]], slice(self.head_at[k], self.head_at[k + 1])

    def messages(self, block: Block) -> list[dict]:
        train = np.bincount(self.of_token[block.train], minlength=len(self.context))
        rows = []
        for s, grams, h in self.parts():
            heads = self.head_context[h]
            rows.append({"shard": s, "block": block.number, "contexts": _steps(self.sent_keys[heads]), "totals": _planes(self.totals[heads]), "runs": _planes(self.head_run[h]), "words": _planes(self.ids[self.word[grams]]), "counts": _planes(train[grams])})
        return rows

    def known(self, replies: list[dict] | None, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Count of each n-gram in training, and for those that have one its key as a context."""
        counts, keys = np.zeros(len(self.context), np.int64), np.zeros(len(self.context), np.uint64)
        by_shard = {r["shard"]: r for r in replies or ()}
        for s, grams, _ in self.parts():
            have = grams[_unpacked(by_shard[s]["data"][16:], np.uint8) > 0]
            counts[have] = _from_planes(by_shard[s]["counts"]).astype(np.int64)
            keys[have] = (_from_steps(by_shard[s]["places"]) + np.uint64(1)) * np.uint64(shards) + np.uint64(s)
        return counts, keys

    def probabilities(self, replies: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        """The stored probability of each n-gram, and the weight of the order below."""
        stored, successors = np.zeros(len(self.context)), np.zeros(len(self.keys), np.int64)
        by_shard = {r["shard"]: r for r in replies or ()}
        for s, grams, h in self.parts():
            r = by_shard[s]
            least, step = np.frombuffer(r["data"][:16], "<f8")
            codes = _unpacked(r["data"][16:], np.uint8).astype(np.float64)
            stored[grams] = np.where(codes > 0, 10 ** (least + step * (codes - 1)), 0.0)
            successors[self.head_context[h]] += _from_planes(r["more"]).astype(np.int64)
        total = self.totals[self.context]
        return stored, np.where(total > 0, DISCOUNT * successors[self.context] / np.maximum(total, 1), 1.0)


def _word_counts(shards: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(WORDS)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts = np.bincount(b.codes[b.train], minlength=len(b.hashes))
                order, at = b.word_order(shards)
                rows = [{"shard": s, "block": b.number, "hashes": b.hashes[w].tobytes(), "counts": _packed(counts[w].astype("<i8"))} for s in np.flatnonzero(np.diff(at)).tolist() if len(w := order[at[s] : at[s + 1]])]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return each


_NOTHING = {"more": b"", "places": b"", "counts": b"", "n": 0, "v": 0}


def _word_totals(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    _, of = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(of, weights=np.concatenate([_unpacked(r["counts"], "<i8") for r in rows])).astype("<i8")
    out, at = [], 0
    for k, (r, h) in enumerate(zip(rows, hashes)):
        stat = {"n": int(totals.sum()), "v": int((totals > 0).sum())} if k == 0 else {}
        mine = of[at : at + len(h)]
        out.append({**_NOTHING, "block": r["block"], "shard": r["shard"], "data": _packed(totals[mine]), "more": _planes(mine), **stat})
        at += len(h)
    return pa.Table.from_pylist(out, _arrow(TOTALS))


def _sent(order: int, n_tokens: int, word_shards: int, shards: int):
    """Messages of the bigrams, or trigrams, of blocks with the replies that they have so far."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                b.learn_words(row["words"], word_shards)
                grams = b.bigrams(n_tokens, shards)
                if order == 3:
                    grams = b.trigrams(grams, row["bigrams"], n_tokens, shards)
                yield pa.RecordBatch.from_pylist(grams.messages(b), _arrow(GRAMS))

    return each


def _shard_codes(order: int):
    """Builds the level of a shard and answers each block."""

    def each(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads = [_from_steps(r["contexts"]) for r in rows]
        runs = [_from_planes(r["runs"]).astype(np.int64) for r in rows]
        words = [_from_planes(r["words"]) for r in rows]
        contexts, first, rank = np.unique(np.concatenate(heads), return_index=True, return_inverse=True)
        total = np.concatenate([_from_planes(r["totals"]) for r in rows])[first].astype(np.int64)
        word, count = np.concatenate(words), np.concatenate([_from_planes(r["counts"]) for r in rows]).astype(np.int64)
        context, ids, bits = np.repeat(rank, np.concatenate(runs)), None, int(word.max(initial=0)).bit_length()
        if len(contexts).bit_length() + bits > 63:
            ids, word = np.unique(word, return_inverse=True)
            bits = 32
        key = context << bits | word.astype(np.int64)
        by = np.argsort(key, kind="stable")  # each block's part is in order already
        key, of = key[by], np.empty(len(key), np.int64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        of[by] = np.cumsum(new) - 1  # the n-gram of each entry, whatever block sent it
        key, count = key[new], np.add.reduceat(count[by], np.flatnonzero(new)) if len(key) else count
        context, word = key >> bits, key & ((1 << bits) - 1)
        word = (word if ids is None else ids[word]).astype(np.uint64)
        trained = count > 0
        successors = np.bincount(context[trained], minlength=len(contexts))
        trie = Trie(contexts, np.append(0, np.cumsum(successors)), word[trained], (count[trained] - DISCOUNT) / np.maximum(total[context[trained]], 1))
        # all that the blocks ask is searched in one pass through the level
        place = trie.places(trie.rank(contexts)[context], word)
        code = np.zeros(len(place), np.uint8)
        code[place >= 0] = trie.codes[place[place >= 0]]
        scale, out, at, head = np.array([trie.least, trie.step], "<f8").tobytes(), [], 0, 0
        for r, h, w in zip(rows, heads, words):
            mine = of[at : at + len(w)]
            have = mine[code[mine] > 0]
            more = {"places": _steps(place[have]), "counts": _planes(count[have])} if order == 2 else {}  # they are asked for as contexts
            out.append({**_NOTHING, "block": r["block"], "shard": r["shard"], "data": scale + _packed(code[mine]), "more": _planes(successors[rank[head : head + len(h)]]), **more})
            at, head = at + len(w), head + len(h)
        pa.default_memory_pool().release_unused()  # what groups before this one needed
        return pa.Table.from_pylist(out, _arrow(TOTALS))

    return each


def _scored(n_tokens: int, n_words: int, word_shards: int, shards: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                b.learn_words(row["words"], word_shards)
                base = (b.counts + ADD) / (n_tokens + ADD * (n_words + 1))
                grams = b.bigrams(n_tokens, shards)
                stored, backoff = grams.probabilities(row["bigrams"])
                two = (stored + backoff * base[grams.word])[grams.of_token]
                grams = b.trigrams(grams, row["bigrams"], n_tokens, shards)
                stored, backoff = grams.probabilities(row["trigrams"])
                log = np.log10(stored[grams.of_token] + backoff[grams.of_token] * two)
                add = lambda x: np.add.reduceat(x, b.starts)  # noqa: B023, E731
                columns = [b.doc_ids, b.held, b.sizes, add((b.counts > 0).astype(np.int64)[b.codes]), [n_tokens] * len(b.sizes), add(np.log10(base)[b.codes]), add(log)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(SCORES))], schema=_arrow(SCORES))

    return each


def _by_block(replies: DataFrame, name: str) -> DataFrame:
    """One row for each block with all the replies to it."""
    return replies.groupBy("block").agg(F.collect_list(F.struct("shard", "data", "more", "places", "counts")).alias(name))


def score(documents: DataFrame, held_out: int = HELD_OUT, block_tokens: int = BLOCK_TOKENS, shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each document, scored by the model of those whose crc32(doc_id) is no multiple of held_out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out == 0, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    blocks = bucketed(rows.mapInArrow(_blocks(block_tokens), BLOCKS), "lm-blocks", "block")
    tokens, words = blocks.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    if tokens is None:
        return documents.sparkSession.createDataFrame([], SCORES)
    word_shards, shards = 1 + words // shard_words, 1 + tokens // shard_tokens
    replies = written(blocks.mapInArrow(_word_counts(word_shards), WORDS).groupBy("shard").applyInArrow(_word_totals, TOTALS), "lm-words", compression="zstd")
    n_tokens, n_words = replies.agg(F.sum("n"), F.sum("v")).first()
    numbers = n_tokens, word_shards, shards
    asked = lambda have, order: have.mapInArrow(_sent(order, *numbers), GRAMS).groupBy("shard").applyInArrow(_shard_codes(order), TOTALS)
    have = blocks.join(bucketed(_by_block(replies, "words"), "lm-words", "block"), "block")
    have = have.join(bucketed(_by_block(asked(have, 2), "bigrams"), "lm-bigrams", "block"), "block", "left")
    have = have.join(_by_block(asked(have, 3), "trigrams"), "block", "left")
    return have.mapInArrow(_scored(n_tokens, n_words, word_shards, shards), SCORES)
