"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lanternlog.llm.words import pieces, split

VOCABULARIES = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Words whose sizes a worker keeps; beyond it starts anew.
KEPT = 400_000


@functools.lru_cache(2)
def ranks(folder: str, name: str) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Sizer:
    """Counts tokens; a word's size is computed once and kept."""

    def __init__(self, folder: str = VOCABULARIES, name: str = NAME):
        import tiktoken

        # the words are split already, so the pattern takes each as a whole
        self.encoding = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(folder, name), special_tokens={})
        self.sizes: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        joined, starts, per = split(texts)
        words = pieces(joined, starts)
        if len(self.sizes) > KEPT:
            self.sizes.clear()
        get = self.sizes.get
        found = [get(w) for w in words]
        if None in found:
            encode, sizes = self.encoding.encode_ordinary, self.sizes
            for i, size in enumerate(found):
                if size is None:
                    size = get(words[i])
                    if size is None:
                        size = sizes[words[i]] = len(encode(words[i]))
                    found[i] = size
        total = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        ends = np.cumsum(per)
        return total[ends] - total[ends - per]


_sizers: dict[tuple[str, str], Sizer] = {}


def sizer(folder: str, name: str) -> Sizer:
    if (folder, name) not in _sizers:
        _sizers[folder, name] = Sizer(folder, name)
    return _sizers[folder, name]


def chunks(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text, one row at least."""
    data = batch[column]
    size = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]) if len(data) else np.zeros(0, np.int64)
    group = np.cumsum(size, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(data)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def add_sizes(text: str, keep: list[str], folder: str = VOCABULARIES, name: str = NAME):
    """A mapInArrow function: the columns of `keep`, and n_tokens of `text` (0 for null and empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sizer(folder, name)
        for whole in batches:
            for batch in chunks(whole, text):
                sizes = count([t or "" for t in batch[text].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    return run
