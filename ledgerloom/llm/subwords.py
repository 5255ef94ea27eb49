"""Hashed word and character n-gram features of whole texts, as positions in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import SPACE, _tables, byte_codes, spans

#: n-gram lengths in bytes of UTF-8.
NGRAMS = (3, 5)

_CODES = byte_codes(lower=False, seed=3)


def _bucket(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64((0xD6E8FEB86659FD93 + 2 * salt) & ((1 << 64) - 1))
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def families(
    data: np.ndarray, offsets: np.ndarray, bits: int, ngrams: tuple[int, ...] = NGRAMS, pairs: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words, n-grams of each length, and with ``pairs`` word pairs: table positions, and each row's slice of them.

    A word behind itself is one pair whatever the word is, so that repetition is a feature.
    """
    powers, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers[: len(data)], out=sums[1:])
    starts, ends, first = spans(~SPACE[data], offsets)
    words = (sums[ends] - sums[starts]) * inverse[starts]
    yield _bucket(words, 0, bits), first[:-1], first[1:]
    if pairs:
        m = max(0, len(words) - 1)
        both = words[1:] * np.uint64(3) + words[:m]
        both[words[1:] == words[:m]] = 1
        begin = np.minimum(first[:-1], m)
        yield _bucket(both, 1, bits), begin, np.maximum(begin, np.minimum(first[1:] - 1, m))
    for n in ngrams:
        m = max(0, len(data) - n + 1)
        found = (sums[n:] - sums[:m]) * inverse[:m] if m else np.zeros(0, np.uint64)
        begin = np.minimum(offsets[:-1], m)
        yield _bucket(found, n, bits), begin, np.maximum(begin, np.minimum(offsets[1:] - n + 1, m))


def slice_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of slices, off running sums in double precision."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:], dtype=np.float64)
    return total[end] - total[begin]
