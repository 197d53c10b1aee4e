"""Splits texts as the byte-level tokenizers' pattern does, for whole batches at once.

The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

#: What a lone apostrophe joins with.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3
_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of each code point."""
    if not _KIND:
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                table[c] = LETTER if k == "L" else NUMBER
        table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
        _KIND.append(table)
    return _KIND[0]


def split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, byte starts of tokens (with the end added), first token of each row (with the end added), byte offsets of rows.

    Null counts as empty. Tokens follow each other without gaps.
    """
    texts = [t or "" for t in text.to_pylist()]
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(points)
    row = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    data = np.frombuffer(whole.encode(), np.uint8)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    kind = kinds()[points]
    edge = np.zeros(n + 1, bool)  # a row begins here, or all ends
    edge[row] = True
    start = np.r_[True, kind[1:] != kind[:-1]] | edge[:-1]  # of runs of one class
    run = np.flatnonzero(start)
    stop = np.r_[run[1:], n]
    white = kind[run] == WHITE
    # The last white place before a token of the same row stands alone, or joins it if it is a plain space.
    before = white & ~edge[stop]
    last = stop[before] - 1
    start[last] = True
    joins = last[points[last] == 32]
    start[joins + 1] = False
    # A lone apostrophe that begins a token and is followed by letters may join with the first of them.
    alone = run[(kind[run] == OTHER) & (stop - run == 1) & (points[run] == 39) & ~edge[stop]]
    alone = alone[start[alone]]
    if len(alone):
        alone = alone[kind[alone + 1] == LETTER]
        room = np.searchsorted(np.flatnonzero(edge), alone, side="right")
        ends = np.flatnonzero(edge)[room]  # end of the row
        at = lambda k: np.where(alone + k < ends, points[np.minimum(alone + k, n - 1)], 0)
        one, two = at(1), at(2)
        size = np.zeros(len(alone), np.int64)
        for e in ENDINGS:
            fits = (one == ord(e[0])) & ((two == ord(e[1])) if len(e) > 1 else True)
            size = np.where((size == 0) & fits, len(e), size)
        got = size > 0
        start[alone[got] + 1] = False
        after = alone[got] + 1 + size[got]
        start[after[after < n]] = True
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    place = np.r_[0, np.cumsum(width)]
    first = np.flatnonzero(start)
    return data, np.r_[place[first], place[n]], np.searchsorted(first, row), place[row]
