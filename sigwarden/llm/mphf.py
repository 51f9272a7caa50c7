"""Minimal perfect hashing of 128-bit keys in one shard, with a fingerprint and a count for each key.

Levels of bit arrays: a key stays on the first level where no other remaining key shares its
position; its slot is the number of bits set before it. Keys left after the last level are listed.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2.0, 24


def _position(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = (a + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) ^ (b * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) % np.uint64(bits)


def _fingerprint(b: np.ndarray) -> np.ndarray:
    return (b >> np.uint64(48)).astype(np.uint16)


def build(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> bytes:
    """The index of the different keys (a, b), two uint64 halves each; counts must fit uint16."""
    left, sizes, words, found, values = np.arange(len(a)), [], [], [], []
    while len(left) and len(sizes) < LEVELS:
        bits = max(64, int(np.ceil(GAMMA * len(left) / 64)) * 64)
        at = _position(a[left], b[left], len(sizes), bits).astype(np.int64)
        alone = np.bincount(at, minlength=bits)[at] == 1
        mask = np.zeros(bits, np.uint8)
        mask[at[alone]] = 1
        sizes.append(bits)
        words.append(np.packbits(mask, bitorder="little"))
        found.append(left[alone][np.argsort(at[alone], kind="stable")])
        left = left[~alone]
    order = np.concatenate([*found, left]).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    head = np.array([len(a), len(left), len(sizes), *sizes], np.int64)
    values = [a[left].astype(np.uint64), b[left].astype(np.uint64), *words, _fingerprint(b[order]), counts[order].astype(np.uint16)]
    return head.tobytes() + b"".join(x.tobytes() for x in values)


class Index:
    """A built index, for probing."""

    def __init__(self, blob: bytes):
        n, spare, levels = np.frombuffer(blob, np.int64, 3).tolist()
        self.sizes = np.frombuffer(blob, np.int64, levels, 24).tolist()
        at = 24 + 8 * levels
        self.spare = dict(zip(zip(np.frombuffer(blob, np.uint64, spare, at).tolist(), np.frombuffer(blob, np.uint64, spare, at + 8 * spare).tolist()), range(n - spare, n)))
        at += 16 * spare
        self.words, self.before, rank = [], [], 0
        for bits in self.sizes:
            w = np.frombuffer(blob, np.uint64, bits // 64, at)
            ones = np.bitwise_count(w).astype(np.int64)
            self.words.append(w)
            self.before.append(rank + np.cumsum(ones) - ones)
            rank += int(ones.sum())
            at += bits // 8
        self.fingerprints = np.frombuffer(blob, np.uint16, n, at)
        self.counts = np.frombuffer(blob, np.uint16, n, at + 2 * n)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The counts of the keys; 0 where the fingerprint tells that a key is none of the index."""
        slot = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _position(a[left], b[left], level, bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            w = self.words[level][word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[hit]] = (self.before[level][word] + below)[hit]
            left = left[~hit]
        if self.spare:
            for i in left.tolist():
                slot[i] = self.spare.get((int(a[i]), int(b[i])), -1)
        out = np.zeros(len(a), np.uint16)
        ok = np.flatnonzero(slot >= 0)
        ok = ok[self.fingerprints[slot[ok]] == _fingerprint(b[ok])]
        out[ok] = self.counts[slot[ok]]
        return out
