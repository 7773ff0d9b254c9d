"""Hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from trendspark.llm.common import as_bytes, batches_by_size

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """64-bit hash of a word; starts anew when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` codes, built from runs of powers of two."""
    done, total, power = 0, None, codes
    width = 1
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while width <= length:
        if length & width:
            part = power[done:done + n]
            total = part if total is None else mix(total * _B + part)
            done += width
        if width * 2 <= length:
            power = mix(power[:-width] * _A + power[width:])
        width *= 2
    return total


def word_codes(words: list[bytes], hashes: Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[dict[bytes, int]]:
    """Distinct texts with their counts, about ``limit`` bytes at once."""
    waiting: dict[bytes, int] = {}
    size = 0
    for batch in batches_by_size(batches, column, 1 << 22):
        for data in as_bytes(batch.column(column)):
            size += 0 if data in waiting else len(data)
            waiting[data] = waiting.get(data, 0) + 1
        if size >= limit:
            yield waiting
            waiting, size = {}, 0
    if waiting:
        yield waiting


def text_hash(data: bytes) -> int:
    """64-bit hash of a text, equal to Spark's ``xxhash64``."""
    return (xxhash.xxh64_intdigest(data, 42) ^ 1 << 63) - (1 << 63)
