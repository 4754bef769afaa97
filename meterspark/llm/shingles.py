"""Vectorised word and shingle hashing of whole texts (numpy inside Arrow tasks).

A batch of texts is one byte buffer.  A-Z are lower-cased through a table,
words are maximal runs of bytes other than space and 0x09-0x0D (so multi-byte
characters stay inside words), and each word gets a 64-bit polynomial hash
from one running sum over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time: keeps the 8-byte work arrays small (a longer single text is one slice).
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_low = np.arange(256)
_low[65:91] += 32
_BYTE_LOWER = _BYTE[_low]
#: Word separators: the white space of the shingle words; all ASCII but letters and digits for plain words.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_K = _U(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 1)
        base = np.full(size, _P, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
        base[1:] = _U(_P_INV)
        _INVERSE = np.multiply.accumulate(base)
    return _POWERS, _INVERSE


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (two multiply-xorshift rounds)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes each (at least one text)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of one slice of texts, and the first word of each text (+ total)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~sep[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def words(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()):
    """Word hashes of one slice of texts: (hash, start byte, end byte, first word of each text + total).

    With ``prefixes`` the hash has a column for the word and one for each prefix of so many bytes.
    """
    base = int(offsets[0])
    data, off = raw[base:int(offsets[-1])], offsets - base
    n = len(data)
    if not n:
        shape = (0, 1 + len(prefixes)) if prefixes else 0
        return np.zeros(shape, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start, end, first = word_spans(data, off, sep)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start])
    if prefixes:
        heads = [mix((total[np.minimum(start + p, end)] - total[start]) * inverse[start], 40 + p) for p in prefixes]
        h = np.column_stack([h, *heads])
    return h, start + base, end + base, first


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the first shingle of each text (+ total); not yet distinct.

    A text of fewer words (but at least one) has its whole sequence as one shingle.
    """
    n_words = np.diff(first)
    n = len(h)
    roll = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        roll = roll * _K + h[j:j + len(roll)]
    roll = mix(roll, 5)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    at = first[:-1][doc] + np.arange(begin[-1]) - begin[doc]
    out = np.empty(begin[-1], np.uint64)
    full = n_words[doc] >= width
    out[full] = roll[at[full]]
    for d in np.flatnonzero((n_words > 0) & (n_words < width)):
        x = _U(int(n_words[d]))
        for w in h[first[d]:first[d + 1]]:
            x = np.multiply(x, _K, dtype=np.uint64) + w
        out[begin[d]] = mix(np.array([x], np.uint64), 7)[0]
    return out, begin


def distinct_sets(out: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, joined, and where each text's set begins (+ total)."""
    parts = [np.unique(out[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])


def text_sets(col: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices [a, b) of a text column: (a, b, joined sorted distinct shingles, set begins)."""
    raw, offsets = text_buffers(col)
    with np.errstate(over="ignore"):
        for a, b in slices(offsets):
            h, _, _, first = words(raw, offsets[a:b + 1])
            yield (a, b, *distinct_sets(*shingles(h, first, width)))
