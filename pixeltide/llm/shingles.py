"""Shingle sets of texts, as sorted 64-bit hashes, and Min-Max signatures."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from pixeltide.llm.workers import keys, mixed, word_hashes


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The distinct ``words``-word shingles of each row, sorted; a shorter text is one shingle, an empty one none."""
    hashes, _, of_row = word_hashes(raw, bounds)
    weight = keys(words, 2)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    rolled = sum(padded[k : k + len(hashes)] * weight[k] for k in range(words)) if len(hashes) else hashes
    rolled = mixed(rolled) if len(hashes) else hashes
    out = []
    for first, last in zip(of_row[:-1].tolist(), of_row[1:].tolist()):
        n = last - first
        if n >= words:
            out.append(np.unique(rolled[first : last - words + 1]))
        elif n:
            own = hashes[first:last] * weight[:n]
            out.append(mixed(own.sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(hashes[:0])
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes [row, 2] that are equal for equal sets."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return out


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = keys(2 * n, 3)
    return ((both[:n] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32), (both[n:] >> np.uint64(32)).astype(np.uint32)


def min_max(values: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a set under each permutation x -> a x + b of 32-bit integers.

    One evaluation of a permutation gives two signature values. Each agrees
    between two sets with a chance equal to their similarity.
    """
    factor, shift = _permutations(permutations)
    low = np.full(permutations, 0xFFFFFFFF, np.uint32)
    high = np.zeros(permutations, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):  # stays in the cache
        y = x[None, at : at + 1024] * factor[:, None]
        y += shift[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of ``rows`` values each: first of the minima, then of the maxima.

    A band holds values of different permutations only, so its chance to agree
    is the similarity to the power ``rows``.
    """
    values = np.concatenate([low, high]).astype(np.uint64).reshape(-1, rows)
    weight = keys(values.size, 4).reshape(values.shape)
    return mixed((mixed(values + weight) * weight).sum(axis=1, dtype=np.uint64))
