"""Vectorised word kernels over Arrow string buffers.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.  UTF-8 never uses those bytes inside a
longer character, so working on bytes gives the words of the code points.  Each word gets a 64-bit polynomial hash;
all words of a chunk of documents are hashed at once from one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.RandomState(20240501)
_VALUE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_VALUE_LOWER = _VALUE[_LOWER]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_FOLD = _rng.randint(1, 2**63 - 1, 64, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads each input bit over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about ``limit`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (with one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = _IS_WORD[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < n]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = _grown(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * _FOLD[63])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, regardless of documents; k of at most 60."""
    if len(words) < k:
        return np.zeros(0, U)
    total = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _FOLD[i]
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a whole word sequence of under 60 words, apart from those of full windows."""
    return mix(np.array([(words * _FOLD[: len(words)]).sum(dtype=U) ^ U(len(words) * 0x5851F42D4C957F2D % 2**64)], U))


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); under k words the whole sequence is one shingle."""
    for lo, hi, buf, offs in chunks(column):
        starts, ends, first = word_bounds(buf, offs)
        words = span_hashes(buf, starts, ends, lower)
        windows = window_hashes(words, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield lo + i, np.unique(windows[a : b - k + 1])
            elif b > a:
                yield lo + i, sequence_hash(words[a:b])
            else:
                yield lo + i, np.zeros(0, U)


def coded(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    """Number of each span among the distinct spans, and those; spans of these lengths follow each other in data."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    made = pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return made.indices.to_numpy(), made.dictionary


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] one after another."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
