"""Bloom filters of bounded size with two planes: keys that were seen, and keys that were seen twice.

Every key has HASHES places in a plane of ``bits`` bits. A task counts its places and sends on only those that it has,
as differences between sorted places; all rows of one slice of the planes are merged in a stream. A place that two rows
hold is in the second plane, and so a key that was seen twice has all its places there: neither plane ever misses a key.
How often they hold one wrongly depends on the keys for each bit; callers confirm what the filter lets through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

HASHES = 2
#: Bits of a plane for each key, and in all at least and at most. The latter is what is sent to every executor: 128 MB.
KEY_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 30
#: Bits of a slice, a power of two, and places that a task holds before it sends them on.
SLICE_BITS, HELD = 1 << 20, 1 << 22

PARTS = "slice int, once binary, twice binary"


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    """Bits of a plane for so many keys: a power of two between LEAST_BITS and most."""
    return min(most, max(LEAST_BITS, 1 << max(0, KEY_BITS * keys - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of unsigned 64-bit hashes, one row for each; those of one hash differ."""
    low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _pack(at: np.ndarray) -> bytes:
    """Sorted places as their differences, in the least width that holds them; the first byte is the width."""
    apart = np.diff(at, prepend=0)
    width = next(w for w in (1, 2, 4) if not len(at) or int(apart.max()) < 1 << 8 * w)
    return bytes([width]) + apart.astype(f"<u{width}").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"<u{packed[0]}", offset=1), dtype=np.int64)


class Seen:
    """Places that one task has seen, once or more often. Each key of a document counts once in it."""

    def __init__(self, bits: int) -> None:
        self.bits, self.held, self.n = bits, [], 0

    def add(self, hashes: np.ndarray) -> Iterable[pd.DataFrame]:
        self.held.append(places(hashes, self.bits).ravel())
        self.n += len(self.held[-1])
        if self.n >= HELD:
            yield self.rest()

    def rest(self) -> pd.DataFrame:
        at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        self.held, self.n = [], 0
        which, rows = at // SLICE_BITS, []
        edges = np.flatnonzero(np.diff(which, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = at[a:b] % SLICE_BITS
            rows.append((int(which[a]), _pack(own), _pack(own[n[a:b] > 1])))
        return pd.DataFrame(rows, columns=["slice", "once", "twice"])


def _merge(twice: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        last, planes = None, np.zeros((2, SLICE_BITS), bool)
        row = lambda: pd.DataFrame({"slice": [last], "bits": [np.packbits(planes[int(twice)], bitorder="little").tobytes()]})
        for batch in batches:
            for which, once, again in zip(batch["slice"], batch["once"], batch["twice"], strict=True):
                if which != last:
                    if last is not None:
                        yield row()
                    last, planes[:] = which, False
                at = _unpack(once)
                planes[1][at[planes[0][at]]] = True
                planes[1][_unpack(again)] = True
                planes[0][at] = True
        if last is not None:
            yield row()

    return run


def plane(parts: DataFrame, bits: int, twice: bool) -> np.ndarray:
    """One plane of all parts, as bytes; at most MOST_BITS come to the driver."""
    slices = parts.repartition("slice").sortWithinPartitions("slice").mapInPandas(_merge(twice), "slice int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in slices.collect():
        out[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def sent(parts: DataFrame, bits: int, twice: bool) -> Broadcast:
    return parts.sparkSession.sparkContext.broadcast(plane(parts, bits, twice).tobytes())


#: Hashes that are looked up at once.
BLOCK = 1 << 16


def holds(sent_plane: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash, True if the plane may hold it."""
    bits, out = np.frombuffer(sent_plane, np.uint8), np.empty(len(hashes), bool)
    for k in range(0, len(hashes), BLOCK):
        at = places(hashes[k : k + BLOCK], 8 * len(bits))
        out[k : k + BLOCK] = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
    return out
