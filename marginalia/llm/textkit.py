"""Array kernels over the UTF-8 bytes of an Arrow string column: words, hashes and rolling windows.

All functions take whole batches, so no Python code runs per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The bytes 0x20 and 0x09 to 0x0D, which part words.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A to Z to lower case; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd factors of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK_BYTES, HASH_BYTES = 1 << 20, 1 << 18


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, and of one row at least."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``inside``, and for each row the number of its first run."""
    return mask_spans(inside[data], off)


def mask_spans(m: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a mask of the bytes; runs end with their row."""
    n = len(m)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    edges = off[:-1][off[:-1] < n]
    before[edges] = False
    start = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(start, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix: spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than the values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values))[0], dtype=U64, out=out[1:])
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; starts and ends ascend. Works in blocks of HASH_BYTES, to hold little at once."""
    out = np.zeros(len(start), U64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + HASH_BYTES)))
        first, past = start[at], end[to - 1]
        s = sums(data[first:past].astype(U64) + U64(1), base)
        b = start[at:to] - first
        out[at:to] = mix((s[end[at:to] - first] - s[b]) * powers(base, past - first + 1)[1][b])
        at = to
    return out


def rolling(hashes: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """A 64-bit hash of each ``k`` hashes in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    s = sums(hashes, base)
    return mix((s[k:] - s[:-k]) * powers(base, len(hashes))[1][:n])


def bytes_to_strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A string column from valid UTF-8 bytes and offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, equal places of all numbers together, which compresses well."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays)


def unpack(data: bytes, *shapes: tuple[type, int]) -> list[np.ndarray]:
    """What ``pack`` packed, by the type and length of each array."""
    out, at = [], 0
    for kind, n in shapes:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out
