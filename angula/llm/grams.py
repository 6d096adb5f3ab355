"""Words and shingles of Arrow text columns as 64-bit hashes, for whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: space, \\t, \\n, \\v, \\f, \\r. No byte of a longer UTF-8 character is among them.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text hashed at once; a longer document is a slice of its own.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE + 1), base, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=np.uint64)
    return _pow[0], _pow[1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first byte and last byte + 1 of each word of the documents data[at[i]:at[i + 1]], lower-cased A-Z."""
    lo, n = at[0], int(at[-1] - at[0])
    b, own = data[lo : lo + n], at - lo
    full = ~_SPACE[b]
    first = full.copy()
    first[1:] &= ~full[:-1]
    edge = own[own < n]
    first[edge] = full[edge]
    last = full.copy()
    last[:-1] &= ~full[1:]
    edge = own[own > 0] - 1
    last[edge] = full[edge]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[:n], out=run[1:])
    h = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(own, s, "right") - 1, s + lo, e + lo


def sliced(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of documents that are short together."""
    data, at = texts(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, j, data, at[i : j + 1]
        i = j


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of n words within one document."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    inside = doc[: len(out)] == doc[n - 1 :]
    return mix(out[inside]), doc[: len(out)][inside]


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, sizes, ends, hashes): each row's distinct shingles, ascending; with fewer words the whole sequence is one."""
    for i, j, data, at in sliced(column):
        h, doc, _, _ = words(data, at)
        g, of = grams(h, doc, n)
        count = np.bincount(doc, minlength=j - i)
        if (few := np.flatnonzero((count > 0) & (count < n))).size:
            begin = np.searchsorted(doc, few)
            whole = [mix(np.array([sum(int(x) * pow(_BASE, k + 1, 1 << 64) for k, x in enumerate(h[a : a + count[d]])) + int(count[d]) & (1 << 64) - 1], np.uint64))[0] for d, a in zip(few, begin)]
            g, of = np.concatenate([g, np.array(whole, np.uint64)]), np.concatenate([of, few])
        order = np.lexsort((g, of))
        g, of = g[order], of[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
        g, of = g[keep], of[keep]
        sizes = np.bincount(of, minlength=j - i)
        yield i, sizes, np.cumsum(sizes), g


def set_keys(sizes: np.ndarray, ends: np.ndarray, g: np.ndarray) -> np.ndarray:
    """One key for each set, the same for equal sets; 0 for the empty one."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ np.uint64(_BASE)), dtype=np.uint64)])
    key = mix(run[ends] - run[ends - sizes] + sizes.astype(np.uint64))
    return np.where(sizes > 0, np.where(key == 0, np.uint64(1), key), np.uint64(0))
