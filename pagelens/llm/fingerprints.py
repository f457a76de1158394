"""Fingerprints of words and of runs of words, many at once, with numpy.

A word of at most seven bytes is a number by itself, so no two of them are alike; a longer one is hashed as a
whole. A run takes in its words one after the other, mixing after each, so that no sum of powers can cancel.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Bytes of a word that fit into a number beside its length.
SHORT = 7


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes and length of each word as one number, the length in its highest byte; true to those of at most ``SHORT`` bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[starts].view("<u8").reshape(-1)
    kept = np.minimum(sizes, SHORT).astype(np.uint64)
    return (eight & ((np.uint64(1) << (kept * np.uint64(8))) - np.uint64(1))) | (kept << np.uint64(56))


def of_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of ``data[start:end]`` for each start and end."""
    sizes = ends - starts
    out = mixed(packed(data, starts, sizes))
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        raw = data.tobytes()
        out[long] = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def of_runs(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` words, given the words'."""
    out = np.full(len(words) - width + 1, 0xD6E8FEB86659FD93 * width % (1 << 64), np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ words[i : i + len(out)])
    return out
