"""Hashed character n-grams of batches of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def code_points(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All characters of `texts`, each text with a space before it and `pad` after it; and where each starts, with the end."""
    parts = [f" {t}{' ' * pad}" for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32), bounds


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket under 2 ** bits for the n-gram that starts at each position but the last n - 1."""
    h = points[: len(points) - n + 1] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
    for i in range(1, n):
        h = h * np.uint32(0x01000193) + points[i : len(points) - n + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


def ngram_buckets(texts: Sequence[str], orders: Sequence[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of each n-gram of the lower-cased texts, and the bounds of each text's n-grams.

    Every text has at least one n-gram of each order: spaces are put around it.
    """
    longest = max(orders)
    points, bounds = code_points([t.lower() for t in texts], longest - 1)
    for n in orders:
        h = hashed(points, n, bits)
        yield np.concatenate([h, np.zeros(n - 1, h.dtype)]), bounds


def unique_buckets(texts: Sequence[str], orders: Sequence[int], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (text, bucket), sorted; `wanted` is a flag for each bucket, all are wanted if it is None.

    N-grams that reach into the next text are left out.
    """
    longest, found = max(orders), []
    for h, bounds in ngram_buckets(texts, orders, bits):
        own = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
        keep = np.ones(len(h), bool) if wanted is None else wanted[h]
        for i in range(longest - 1):
            keep[bounds[1:] - 1 - i] = False
        found.append((own[keep] << 32) | h[keep])
    pairs = np.unique(np.concatenate(found))
    return pairs >> 32, pairs & 0xFFFFFFFF
