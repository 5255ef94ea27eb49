"""Canonical length-limited Huffman codes over whole numbers, coded and decoded with numpy.

A coded block starts at a byte and needs nothing but the code lengths, so blocks are independent.
Checkpoints give the bit offset of every ``EVERY``-th id of a block. Decoding reads all stretches
between checkpoints side by side: a table over the next ``limit`` bits has the id and its length.
"""

from __future__ import annotations

import numpy as np

EVERY, LIMIT = 256, 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths up to ``limit`` (package-merge); 0 for ids without occurrences.

    The limit is raised where there are more ids in use than codes of that length.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # Each level merges the coins with the packages (pairs) of the level below, by weight.
    is_coin, level = [], weights
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        at = np.argsort(merged, kind="stable")
        is_coin.append(at < n)
        level = merged[at]
    # Of the last level 2n - 2 items are taken; packages among them take twice as many below.
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for coin in reversed(is_coin):
        coins = int(coin[:take].sum())
        depth[:coins] += 1
        take = 2 * (take - coins)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    out = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for i in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[i]) - last
        out[i], last = code, int(lengths[i])
        code += 1
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A block's bytes and the bit offsets of its checkpoints."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    top = code.astype(np.uint64) << (64 - np.maximum(lengths, 1).astype(np.uint64))
    size = lengths[ids]
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    word, off = at >> 6, (at & 63).astype(np.uint64)
    left = top[ids]
    words = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(left >> off, first)
    # At most one code reaches over the end of a word.
    over = np.flatnonzero((ends - 1) >> 6 != word)
    words[word[over] + 1] |= left[over] << (64 - off[over])
    return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::EVERY].astype(np.uint32)


class Decoder:
    """Reads blocks by a table over the next bits: the code's length above, its id below."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        self.table = np.full(1 << self.bits, 1 << 24, np.uint32)
        code = codes(lengths).astype(np.int64)
        for i in np.flatnonzero(lengths):
            spare = self.bits - int(lengths[i])
            self.table[code[i] << spare : (code[i] + 1) << spare] = int(lengths[i]) << 24 | int(i)

    def __call__(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> np.ndarray:
        """The ids of all blocks (bytes, checkpoints, number of ids) in order."""
        payload = b"".join(b for b, _, _ in blocks) + bytes(8)
        raw = np.frombuffer(payload, np.uint8).astype(np.uint32)
        ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        base, at, left = 0, [], []
        for data, marks, n in blocks:
            at.append(marks.astype(np.int64) + 8 * base)
            left.append(np.minimum(EVERY, n - EVERY * np.arange(len(marks))))
            base += len(data)
        if not at or not sum(map(len, at)):
            return np.zeros(0, np.uint32)
        at, left = np.concatenate(at), np.concatenate(left)
        out = np.zeros((EVERY, len(at)), np.uint32)
        end, down, mask = 8 * (len(ahead) - 1), 32 - self.bits, np.uint32((1 << self.bits) - 1)
        for step in range(int(left.max())):
            seen = (ahead.take(at >> 3) >> (down - (at & 7)).astype(np.uint32)) & mask
            found = self.table.take(seen)
            np.bitwise_and(found, np.uint32(0xFFFFFF), out=out[step])
            at += found >> np.uint32(24)
            np.minimum(at, end, out=at)
        return out.T[np.arange(EVERY) < left[:, None]]
