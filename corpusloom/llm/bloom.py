"""Bloom filters of keys, and of those that occur more than once.

Repeated keys are found by pairs of filters, "once" and "twice", that follow the
keys: keys travel as 64-bit hashes, at most once for each batch that has them, to
the task that owns their range of hashes, and there pass that range's own two
filters as a stream. What comes out are the suspects, which make one filter for
broadcasting. Its bits thus follow the repeated keys, not all keys.

A broadcast filter has a power of two of bits, at most 2**MOST_BITS (16 MB): at
sixteen bits a key up to 8 million repeated keys, at four bits, where a seventh
of the other keys pass, 33 million. Past that it lets more keys pass, which costs
its users shuffling, never results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import tidy

MOST_BITS = 27
_HASHES = 3
_SLICE = 1 << 19  # bits that are merged together
_FAN_IN = 256
_RANGE_KEYS = 1 << 19  # keys of a range of hashes


def bits_for(keys: int) -> int:
    """log2 of the bits for about ``keys`` keys: sixteen a key, within [2**20, 2**MOST_BITS]."""
    return int(min(MOST_BITS, max(20, math.ceil(math.log2(max(1, keys) * 16)))))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(_HASHES, n) bit numbers of 64-bit hashes, by double hashing."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(h + np.uint64(k) * step) & mask for k in range(_HASHES)])


class Bits:
    """A filter with membership tests for arrays of hashes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = places(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, self.bits):
            found &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def filter_of(df: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], bits: int) -> Bits:
    """The filter of the 64-bit hashes that ``hashes`` gives for batches of rows of ``df``.

    Each task fills one; non-empty slices are merged in two steps, and the merged
    ones come to the driver, 2**bits bits at most.
    """
    n_bytes = _SLICE // 8

    @tidy
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = Bits(bits)
        for batch in batches:
            own.add(hashes(batch))
        part = TaskContext.get().partitionId()
        for k in range(0, len(own.data), n_bytes):
            if own.data[k : k + n_bytes].any():
                yield pd.DataFrame({"slice": [k // n_bytes], "part": [part], "bits": [zlib.compress(own.data[k : k + n_bytes].tobytes(), 1)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = np.zeros(n_bytes, np.uint8)
        for data in pdf["bits"]:
            merged |= np.frombuffer(zlib.decompress(data), np.uint8)
        first = pdf.iloc[:1]
        return first.assign(part=first["part"] // _FAN_IN, bits=zlib.compress(merged.tobytes(), 1))

    schema = "slice int, part int, bits binary"
    made = df.mapInPandas(build, schema)
    made = made.groupBy("slice", F.floor(F.col("part") / _FAN_IN).cast("int").alias("__g")).applyInPandas(merge, schema)
    made = made.groupBy("slice").applyInPandas(merge, schema)
    out = Bits(bits)
    for row in made.toLocalIterator():
        out.data[row["slice"] * n_bytes : (row["slice"] + 1) * n_bytes] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


class Repeats:
    """The "twice" filters of all ranges of hashes, with membership tests for arrays of hashes."""

    def __init__(self, range_bits: int, filters: dict[int, np.ndarray]):
        """Bytes of a power of two of bits for each range that has repeated keys."""
        self.range_bits = range_bits
        empty = np.zeros(1, np.uint8)
        parts = [filters.get(r, empty) for r in range(1 << range_bits)]
        sizes = np.array([len(p) for p in parts], np.uint64) * np.uint64(8)
        self.data, self.masks, self.starts = np.concatenate(parts), sizes - np.uint64(1), np.cumsum(sizes) - sizes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.uint64)
        r = _range(h, self.range_bits)
        step, found = (h >> np.uint64(32)) | np.uint64(1), np.ones(len(h), bool)
        for k in range(_HASHES):
            at = self.starts[r] + ((h + np.uint64(k) * step) & self.masks[r])
            found &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _range(h: np.ndarray, range_bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(h), np.int64)


def _folded(data: np.ndarray, most_bytes: int) -> np.ndarray:
    """A filter's bytes, halved as long as that leaves a fifth of the bits set at most, or there are too many."""
    while len(data) > 1:
        half = data[: len(data) // 2] | data[len(data) // 2 :]
        if len(data) <= most_bytes and np.unpackbits(half).sum() > 0.2 * 8 * len(half):
            return data
        data = half
    return data


def repeated(df: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], about: int) -> Repeats:
    """The filter of the 64-bit hashes that ``hashes`` gives at least twice over all rows of ``df``, which is read once.

    Few other hashes pass it. ``about`` is a guess of the number of keys that sizes ranges and their filters only.
    """
    range_bits = max(0, math.ceil(math.log2(max(1, about) / _RANGE_KEYS)))
    bits, most_bytes = bits_for(2 * about >> range_bits), max(1, 1 << (MOST_BITS - 3) >> range_bits)

    @tidy
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, times = np.unique(hashes(batch), return_counts=True)
            yield pd.DataFrame({"r": _range(found, range_bits).astype(np.int32), "h": found.view(np.int64), "again": times > 1})

    @tidy
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: dict[int, tuple[Bits, Bits]] = {}
        for batch in batches:
            for r, part in batch.groupby("r"):
                once, twice = pairs.setdefault(r, (Bits(bits), Bits(bits)))
                found, place, times = np.unique(part["h"].to_numpy(np.int64).view(np.uint64), return_inverse=True, return_counts=True)
                again = np.bincount(place, part["again"], len(found)) > 0
                twice.add(found[again | (times > 1) | once.has(found)])
                once.add(found)
        for r, (_, twice) in pairs.items():
            if twice.data.any():
                yield pd.DataFrame({"r": [r], "bits": [zlib.compress(_folded(twice.data, most_bytes).tobytes(), 1)]})

    made = df.mapInPandas(keys, "r int, h long, again boolean").repartition(1 << range_bits, "r").mapInPandas(fill, "r int, bits binary")
    return Repeats(range_bits, {row["r"]: np.frombuffer(zlib.decompress(row["bits"]), np.uint8) for row in made.toLocalIterator()})
