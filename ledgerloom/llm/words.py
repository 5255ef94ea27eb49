"""Word spans and hashes over the UTF-8 bytes of whole text columns, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit code for each byte; with ``lower``, A-Z share the codes of a-z."""
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


#: Bytes that separate words where only ASCII white space does: 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for n positions."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _powers = np.cumprod(np.full(size, _MULTIPLIER, np.uint64)) * np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        back = pow(_MULTIPLIER, -1, 1 << 64)
        _inverse = np.cumprod(np.full(size, back, np.uint64)) * np.uint64(_MULTIPLIER)
    return _powers, _inverse


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first row, bytes, row offsets) of a string column; null reads as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at rows; and for each row its first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    stops[before] = inside[before]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial in the bytes' codes, read off running sums."""
    powers, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def chain_hashes(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, by the run's first position."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        factor = np.uint64(pow(_MULTIPLIER, 2 * k + seed, 1 << 64))
        total = total + hashes[k : len(hashes) - width + 1 + k] * factor
    return mix(total + np.uint64(width))
