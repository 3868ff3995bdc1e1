"""The words of byte-level BPE: the split of a text by its published pattern, on numpy code-point arrays.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Every boundary follows from the classes of a few neighbouring code points, so
a batch of texts is split with array comparisons instead of a regex engine.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            a, b = ord(every[found.start()]), ord(every[found.end() - 1])
            out[a : b + 1] = value
    out[0xD800:0xE000] = OTHER
    return out


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts joined, starts of the words in it, words of each text)."""
    joined = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kind = classes()[code]
    begin = np.cumsum(size) - size
    first = np.zeros(n + 1, bool)
    first[begin[size > 0]] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == SPACE
    # the last of several blanks, and a single one, joins what follows if it is U+0020
    ends = np.zeros(n, bool)
    ends[:-1] = run[1:] & ~first[1:n]
    last = space & ends
    start |= last
    joins = last & (code == 32)
    start[1:] &= ~(joins[:-1] & ~first[1:n])
    # contractions: an apostrophe alone, not after a joining blank
    tick = np.flatnonzero((code == 39) & start & run)
    tick = tick[(tick + 1 < n)]
    tick = tick[(kind[tick + 1] == LETTER) & ~first[tick + 1]]
    if len(tick):
        one = code[tick + 1]
        after = np.where((tick + 2 < n) & ~first[np.minimum(tick + 2, n)], code[np.minimum(tick + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (after == ord("e")) | (one == ord("l")) & (after == ord("l"))
        start[tick[short | long] + 1] = False
        rest = np.concatenate([tick[short] + 2, tick[long & ~short] + 3])
        start[rest[rest < n]] = True
    starts = np.flatnonzero(start)
    per = np.diff(np.searchsorted(starts, np.concatenate([begin, [n]])))
    return joined, starts, per


def pieces(joined: str, starts: np.ndarray) -> list[str]:
    at = starts.tolist()
    return [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
