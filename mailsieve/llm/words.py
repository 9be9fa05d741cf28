"""Hashes of words and word shingles, for whole slices of texts at once.

Words are runs of bytes other than the six ASCII white-space bytes, with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)
_BYTE = mix(_BYTE * np.uint64(_BASE) + np.uint64(1))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[flat]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    powers = np.full(len(flat) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * powers[:-1], out=sums[1:])
    down = np.full(len(flat) + 1, _INVERSE, np.uint64)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(mix(np.array([seed + 1], np.uint64))[0]))
    edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, edges)]))
    return hashes, counts


def shingle_sets(texts: list[bytes], seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; a text of fewer words is one shingle."""
    hashes, counts = word_hashes(texts, seed)
    factors = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    n = max(len(hashes) - SHINGLE + 1, 0)
    whole = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        whole += hashes[k : k + n] * factors[k]
    whole = mix(whole)
    out, at = [], 0
    for count in counts.tolist():
        if count >= SHINGLE:
            out.append(np.unique(whole[at : at + count - SHINGLE + 1]))
        elif count:
            short = (hashes[at : at + count] * factors[:count]).sum(dtype=np.uint64)
            out.append(mix(np.array([short + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
