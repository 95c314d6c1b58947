"""Bloom filters of 64-bit hashes that partitions make by themselves and that are or-ed together: bounded, whatever the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.textvec import mix

#: Bytes of one row of a filter as it is sent, compressed.
_ROW = 1 << 16
_PROBES = 3


def filter_bits(n: int, most: int) -> int:
    """Bits, a power of two, for n hashes at 16 bits each; never above `most`."""
    bits = 1 << 15
    while bits < 16 * n and bits < most:
        bits *= 2
    return bits


def _probe_bits(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    return (h >> np.uint64(21 * i)) & np.uint64(bits - 1) if bits <= 1 << 21 else mix(h + np.uint64(i)) & np.uint64(bits - 1)


class Filter:
    """What it says is the same for the same content, so texts agree on it."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.bytes = bits, data

    def add(self, h: np.ndarray) -> None:
        for i in range(_PROBES):
            at = _probe_bits(h, self.bits, i)
            np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the filter."""
        left = None
        for i in range(_PROBES):
            at = _probe_bits(h, self.bits, i)
            hit = np.flatnonzero((self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            left, h = hit if left is None else left[hit], h[hit]
        return left

    def share(self) -> float:
        """The share of its bits that are set; the chance that it lets a hash through wrongly is the cube of that."""
        return float(np.bitwise_count(self.bytes).sum(dtype=np.int64)) / self.bits


def build_bytes(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None], combine: np.ufunc) -> np.ndarray:
    """`size` bytes that every partition fills for itself and that are then combined, or-ed or the greatest taken: no more than that reaches the driver.

    Parts that are empty aren't sent, the others compressed: a partition that sets few bytes sends few."""

    def rows(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, size, _ROW):
            part = own[i : i + _ROW]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pa.compress(part, "zstd", asbytes=True)], pa.binary())], names=["at", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        for batch in batches:
            add(own, batch)
        yield from rows(own)

    def opened(at: int, data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, min(_ROW, size - at), "zstd"), np.uint8)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch["at"].to_pylist(), batch["data"].to_pylist(), strict=True):
                part = opened(at, data)
                parts[at] = combine(parts[at], part) if at in parts else part
        for at, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pa.compress(part, "zstd", asbytes=True)], pa.binary())], names=["at", "data"])

    out = np.zeros(size, np.uint8)
    for row in df.mapInArrow(run, "at bigint, data binary").repartition("at").mapInArrow(merge, "at bigint, data binary").collect():
        part = opened(row["at"], row["data"])
        out[row["at"] : row["at"] + len(part)] = part
    return out


def build_filter(hashes: DataFrame, bits: int, add: Callable[[Filter, pa.RecordBatch], None]) -> Filter:
    """The filter of all partitions' hashes."""
    return Filter(bits, build_bytes(hashes, bits // 8, lambda own, batch: add(Filter(bits, own), batch), np.bitwise_or))
