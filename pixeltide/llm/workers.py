"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines do not share that folder, ship the package
    with ``--py-files`` as usual.
    """
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    # Another environment means other workers beside the ones there are, so it is changed only if it must be.
    if ROOT not in [*path.split(":"), *os.environ.get("PYTHONPATH", "").split(":")]:
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows, without a copy; null is empty."""
    offsets_type, step = (np.int64, 8) if pa.types.is_large_string(texts.type) else (np.int32, 4)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, offsets_type, len(texts) + 1, texts.offset * step).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit touches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def slices(texts: pa.Array, limit: int = 400_000):
    """Parts of a text column of about ``limit`` bytes each, at least one row; with the number of the first row."""
    _, bounds = bytes_of(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        yield start, texts.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, their first bytes, and the bounds of each row's words.

    With ``lower``, A-Z count as a-z. Two words differ in their hash but for a
    chance of about 2 to the power -56.
    """
    inside = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(bounds), np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    text = _LOWER[raw[at]] if lower else raw[at]
    sums = np.add.reduceat((text.astype(np.uint64) + np.uint64(1)) * keys(int(place.max()) + 1, 1)[place], first)
    return mixed(sums), starts, np.searchsorted(starts, bounds)
