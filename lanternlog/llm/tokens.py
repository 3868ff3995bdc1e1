"""Encoding a corpus with a public byte-level BPE vocabulary: speculate and verify.

Texts are split into words by the vectorised splitter of words.py. Of the words a worker
hasn't met, greedy longest match proposes tokens, for all positions of all
words at once. A proposal is the BPE encoding exactly if each of its tokens
encodes to itself and every adjacent pair is compatible, that is if the two
tokens' merges cannot be overtaken by a merge across their seam; both are
tested vectorised, a distinct pair once. Only words with a failing pair are
merged exactly.

Null and empty texts give an empty list of ids. Text that looks like a special
token is ordinary text.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lanternlog.llm.sizes import NAME, VOCABULARIES, chunks
from lanternlog.llm.words import pieces, split
from lanternlog.session import spread

#: Words, and tokens of words, that a worker keeps; beyond it starts anew.
KEPT, KEPT_TOKENS = 400_000, 4_000_000
FAR = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by the published rule: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Table:
    """A hash table from int64 keys to int64 values, looked up by arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]  # of several, one stays
            mine = self.keys[slot[left]] == keys[left]
            self.values[slot[left[mine]]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


class Vocabulary:
    """Tokens, merges and the tables made of them. Merges are ranked as listed."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        n = len(tokens)
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for rank, (a, b, c) in enumerate(merges):
            if self.rank[c] < 0:
                self.left[c], self.right[c], self.rank[c] = a, b, rank
        self.merge = {(a << 20) | b: (rank, c) for rank, (a, b, c) in reversed(list(enumerate(merges)))}
        keys = np.fromiter(self.merge, np.int64, len(self.merge))
        self.pair_rank = Table(keys, np.array([self.merge[k][0] for k in keys.tolist()], np.int64))
        self.byte_id = np.zeros(256, np.int64)
        for i, token in enumerate(tokens):
            if len(token) == 1:
                self.byte_id[token[0]] = i
        self._trie()
        whole = [self.merge_exactly(t) for t in tokens]
        self.own = np.array([ids == [i] for i, ids in enumerate(whole)])
        self.known: dict[int, bool] = {}

    @classmethod
    def load(cls, folder: str = VOCABULARIES, name: str = NAME) -> Vocabulary:
        with open(f"{folder}/{name}.json", encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        ids = {text: i for text, i in model["vocab"].items() if all(c in letters for c in text)}
        tokens = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            tokens[i] = bytes(letters[c] for c in text)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])

    def _trie(self) -> None:
        edges: dict[int, int] = {}
        accepts = [-1]
        for i, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(accepts)
                    accepts.append(-1)
            if token:
                accepts[node] = i
        self.edges = Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.accepts = np.array(accepts)

    def merge_exactly(self, word: bytes) -> list[int]:
        """BPE by the definition: always the leftmost pair of lowest rank. A heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        get = self.merge.get
        if len(ids) < 24:
            while len(ids) > 1:
                best = min(((hit[0], i, hit[1]) for i in range(len(ids) - 1) if (hit := get((ids[i] << 20) | ids[i + 1]))), default=None)
                if best is None:
                    break
                ids[best[1] : best[1] + 2] = [best[2]]
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, ids[i], ids[i + 1], hit[1]) for i in range(n - 1) if (hit := get((ids[i] << 20) | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if hit := get((c << 20) | ids[k]):
                    heapq.heappush(heap, (hit[0], i, c, ids[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := get((ids[h] << 20) | c)):
                heapq.heappush(heap, (hit[0], h, ids[h], c, hit[1]))
        return [x for x in ids if x >= 0]

    def longest(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, id) of the longest token at every position; end: where each position's word ends."""
        size, ids = np.ones(len(data), np.int64), self.byte_id[data]
        at = np.arange(len(data))
        node = self.edges.get(data.astype(np.int64))
        depth = 1
        while len(at):
            more = at + depth < end[at]
            at, node = at[more], node[more]
            node = self.edges.get(node << 8 | data[at + depth])
            on = node >= 0
            at, node = at[on], node[on]
            depth += 1
            token = self.accepts[node]
            good = token >= 0
            size[at[good]], ids[at[good]] = depth, token[good]
        return size, ids

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words in turn, where each word's begin, with the end)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        width = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(width)
        size, ids = self.longest(data, np.repeat(ends, width))
        # the positions on the greedy path: from each word's start by jumps, long words the rest of the way in one loop
        on = np.zeros(len(data) + 1, bool)
        at, stop = (ends - width)[width > 0], ends[width > 0]
        for _ in range(48):
            if not len(at):
                break
            on[at] = True
            at = at + size[at]
            more = at < stop
            at, stop = at[more], stop[more]
        for a, b in zip(at.tolist(), stop.tolist()):
            jumps = size[a:b].tolist()
            i = 0
            while a + i < b:
                on[a + i] = True
                i += jumps[i]
        path = np.flatnonzero(on[:-1])
        return ids[path], np.searchsorted(path, np.concatenate([[0], ends]))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the bytes of a and b together is [a, b], for tokens that encode to themselves.

        The merges that make a's right edge and b's left edge are undone, the
        latest first. A pair across the seam that could merge at some state
        must rank before the merge that ends that state, else it never comes.
        """
        ok = np.ones(len(a), bool)
        left, right = a.copy(), b.copy()
        # the rank until which the present state lasts; of merges of one rank the leftmost goes first
        until = np.full(len(a), FAR)
        live = np.arange(len(a))
        while len(live):
            x, y = left[live], right[live]
            seam = self.pair_rank.get(x << 20 | y)
            fails = (seam >= 0) & (seam < until[live])
            ok[live[fails]] = False
            live, x, y = live[~fails], x[~fails], y[~fails]
            rx, ry = self.rank[x], self.rank[y]
            stays = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[stays], x[stays], y[stays], rx[stays], ry[stays]
            # of equal ranks the left is made first, so the right is undone first
            undo_left = rx > ry
            left[live[undo_left]] = self.right[x[undo_left]]
            right[live[~undo_left]] = self.left[y[~undo_left]]
            # before the left token was made its last two parts were apart: a seam of the same rank lies further right and comes later;
            # before the right one was made, a seam of the same rank lies further left and comes first
            until[live] = np.where(undo_left, rx, ry + 1)
        return ok

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words in turn, where each word's begin, with the end)."""
        ids, begin = self.greedy(words)
        count = np.diff(begin)
        word = np.repeat(np.arange(len(words)), count)
        bad = np.zeros(len(words), bool)
        bad[word[~self.own[ids]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else word
        pair = ids[inner] << 20 | ids[inner + 1]
        distinct, which = np.unique(pair, return_inverse=True)
        verdict = np.array([self.known.get(p, -1) for p in distinct.tolist()], np.int8)
        new = np.flatnonzero(verdict < 0)
        if len(new):
            verdict[new] = self.compatible(distinct[new] >> 20, distinct[new] & 0xFFFFF)
            if len(self.known) > 4 * KEPT:
                self.known.clear()
            self.known.update(zip(distinct[new].tolist(), verdict[new].astype(bool).tolist()))
        bad[word[inner[verdict[which] == 0]]] = True
        wrong = np.flatnonzero(bad)
        if not len(wrong):
            return ids, begin
        exact = [self.merge_exactly(words[i]) for i in wrong.tolist()]
        size = count.copy()
        size[wrong] = [len(x) for x in exact]
        after = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(after[-1], np.int64)
        keep = ~bad[word]
        out[(after[word] + np.arange(len(ids)) - begin[word])[keep]] = ids[keep]
        place = np.repeat(after[wrong] - np.concatenate([[0], np.cumsum(size[wrong])[:-1]]), size[wrong]) + np.arange(size[wrong].sum())
        out[place] = [t for x in exact for t in x]
        return out, after


class Encoder:
    """Encodes texts; a word's tokens are computed once and kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.begin, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _learn(self, new: list[str]) -> None:
        ids, begin = self.vocabulary.encode([w.encode("utf-8", "replace") for w in new])
        n = len(self.words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(new) + 1] = self.used + begin
        self.used += len(ids)
        self.words.update(zip(new, range(n, n + len(new))))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's begin, with the end)."""
        joined, starts, per = split(texts)
        words = pieces(joined, starts)
        if len(self.words) > KEPT or self.used > KEPT_TOKENS:
            self.clear()
        get = self.words.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            self._learn(list(dict.fromkeys([w for w, i in zip(words, found) if i < 0])))
            found = [get(w) if i < 0 else i for w, i in zip(words, found)]
        index = np.array(found, np.int64)
        first = self.begin[index]
        size = self.begin[index + 1] - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(first - ends + size, size) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
        return ids, edges


@functools.lru_cache(2)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(Vocabulary.load(folder, name))


def _encode(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids, edges = own([t or "" for t in batch["text"].to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """doc_id, ids of every row of documents (doc_id, text); no shuffle unless there are fewer files than cores."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_encode(folder, name), "doc_id long, ids array<int>")
