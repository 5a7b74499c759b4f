"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D (all ASCII, so working on
UTF-8 bytes equals working on code points) after lower-casing A-Z.  A text's set holds the
hashes of its distinct n-word shingles; a text of fewer than n words has its whole word
sequence as one shingle, and a text without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=_U)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array, limit: int = _CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of rows of about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the bounds of each text's words."""
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    if len(data):
        edge = np.zeros(len(data), bool)
        edge[at[:-1][at[:-1] < len(data)]] = True
        first[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, _U), bounds
    kept = data[inside]
    head = np.cumsum(inside)[starts] - 1
    lengths = np.diff(np.append(head, len(kept)))
    place = np.arange(len(kept)) - np.repeat(head, lengths)
    return mix(np.add.reduceat(_BYTE[kept] * _powers(int(lengths.max()))[place], head)), bounds


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, sorted distinct shingle hashes) of each text."""
    place = mix(np.arange(1, n + 1, dtype=_U)) | _U(1)
    for _, data, at in chunks(texts):
        words, bounds = word_hashes(data, at)
        run = np.zeros(max(0, len(words) - n + 1), _U)
        for j in range(n):
            run += words[j : j + len(run)] * place[j]
        run = mix(run)
        for i in range(len(at) - 1):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= n:
                yield hi - lo, np.unique(run[lo : hi - n + 1])
            elif hi > lo:
                short = words[lo:hi] * _powers(hi - lo) + _U(hi - lo)
                yield hi - lo, mix(np.add.reduce(short, keepdims=True))
            else:
                yield 0, np.zeros(0, _U)
