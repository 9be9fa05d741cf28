"""Helpers for regex work on Arrow string batches (RE2 kernels, linear time).

The kernels are gated: a cheap "does anything match" pass picks the rows that a
group of steps can touch, and only those rows are counted and rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Step = tuple[str, str]  # (RE2 pattern, replacement)


# An alternation of more patterns than this can outgrow the DFA cache of RE2 and fall
# back to its slow matcher.
GATE_WIDTH = 8


# Bytes of text that steps hold at a time; a batch is some tens of megabytes, and every step copies what it rewrites.
SLICE_BYTES = 8 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in order, in runs of about ``most`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(first, last - first)
        first = last


def any_of(patterns) -> list[str]:
    """Alternations that together match where at least one of ``patterns`` does."""
    return [
        "|".join(f"(?:{p})" for p in patterns[i : i + GATE_WIDTH])
        for i in range(0, len(patterns), GATE_WIDTH)
    ]


def _hits(texts: pa.Array, find, pattern: str) -> np.ndarray:
    return pc.fill_null(find(texts, pattern), False).to_numpy(zero_copy_only=False)


def matching_rows(texts: pa.Array, *patterns: str) -> np.ndarray:
    """Positions of the texts that match one of the patterns."""
    hits = [_hits(texts, pc.match_substring_regex, p) for p in patterns]
    return np.flatnonzero(np.logical_or.reduce(hits))


def put_rows(texts: pa.Array, rows: np.ndarray, values: pa.Array) -> pa.Array:
    """``texts`` with the given rows replaced."""
    if len(rows) == len(texts):
        return values
    mask = np.zeros(len(texts), dtype=bool)
    mask[rows] = True
    return pc.replace_with_mask(texts, pa.array(mask), values)


def run_steps(texts: pa.Array, steps: list[Step]) -> pa.Array:
    """Apply the replacements in order; a step nothing matches costs one scan."""
    for pattern, replacement in steps:
        rows = matching_rows(texts, pattern)
        if len(rows):
            done = pc.replace_substring_regex(texts.take(rows), pattern, replacement)
            texts = put_rows(texts, rows, done)
    return texts


def where_present(texts: pa.Array, literal: str, fn) -> pa.Array:
    """Apply ``fn`` to the rows containing ``literal``, leave the others alone."""
    rows = np.flatnonzero(_hits(texts, pc.match_substring, literal))
    return put_rows(texts, rows, fn(texts.take(rows))) if len(rows) else texts


def map_rows(texts: pa.Array, fn) -> pa.Array:
    """Row callback for the few rules a replacement string cannot express."""
    return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string())
