"""Hashed byte n-gram counts of whole texts, in numpy, for the trained classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import chunks_by_size

#: Bytes of text worked on at a time.
CHUNK_BYTES = 1 << 21
#: Fixed odd multipliers of the n-gram hash.
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def count_blocks(texts: list[bytes], buckets: int, longest: int = 3) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of all n-grams of 1 to ``longest`` bytes by bucket: (first, last, matrix) of text ranges.

    A matrix has one row per text; n-grams never cross texts.
    """
    rows = max(1, (1 << 24) // (4 * buckets))
    for lo, hi in chunks_by_size([len(t) + CHUNK_BYTES // rows for t in texts], 2 * CHUNK_BYTES):
        part = texts[lo:hi]
        sizes = np.array([len(t) for t in part])
        flat = np.frombuffer(b"".join(part), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(len(part)), sizes)
        total = np.zeros(len(part) * buckets, np.int64)
        code = np.zeros(len(flat), np.uint32)
        for n in range(longest):
            if len(flat) <= n:
                break
            code = code[: len(flat) - n] * _MULTIPLY[0] + (flat[n:] + np.uint32(1)) * _MULTIPLY[1]
            mixed = (code ^ (code >> np.uint32(15))) * _MULTIPLY[2]
            bucket = (mixed >> np.uint32(8)) % np.uint32(buckets)
            inside = row[: len(flat) - n] == row[n:]
            at = row[: len(flat) - n] * buckets + bucket
            total += np.bincount(at if inside.all() else at[inside], minlength=len(total))
        yield lo, hi, total.reshape(len(part), buckets)


def normal_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row of length 1 (an empty row stays 0), float32."""
    x = np.sqrt(counts.astype(np.float32))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return x
