"""Words of many texts at once, as 64-bit hashes, for code that runs on Arrow batches.

Texts stay in their Arrow buffer: word borders, lower case and a polynomial
hash (prefix sums modulo 2^64 over per-byte random values) are array
operations over at most SLICE_BYTES at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER_VALUE = _VALUE[_LOWER]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in ((0, _BASE), (1, inverse)):
            steps = np.full(n, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls must be filled."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES; a longer text is a range of its own."""
    if not len(texts):
        return
    _, offsets = _buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text).

    Words are maximal runs without blank or U+0009 to U+000D, A-Z lower-cased.
    Null and empty texts have none.
    """
    data, offsets = _buffers(texts.fill_null(""))
    first, last = int(offsets[0]), int(offsets[-1])
    data, offsets = data[first:last], offsets - first
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    full = ~_BLANK[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(full & (border[:-1] | np.concatenate(([True], ~full[:-1]))))
    ends = np.flatnonzero(full & (border[1:] | np.concatenate((~full[1:], [True])))) + 1
    power, inverse = power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER_VALUE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def hash_word(word: str) -> int:
    """Hash of one word, as hash_words gives it."""
    return int(hash_words(pa.array([word]))[0][0])


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text.

    A text with fewer words has its whole sequence as one; without words, none.
    """
    found, counts = hash_words(texts)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE))
    n = len(found)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled += found[k : n - size + 1 + k] * factors[k] if len(rolled) else np.uint64(0)
    rolled = mix(rolled)
    out = []
    at = 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(rolled[at : at + c - size + 1]))
        elif c:
            short = (found[at : at + c] * factors[:c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(mix(np.array([short ^ np.uint64(_BASE)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
