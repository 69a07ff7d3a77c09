"""Bloom filters: over the keys of all texts, of what came once and what came again (the second is kept); and over given hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4
#: Bits for each key that there can be at most; a key that came once is then suspected in about one case of a million.
BITS_A_KEY = 16
#: The filter is at least and at most so large: 512 KB and 64 MB, which is what the driver collects and broadcasts.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 29
#: It is cut into slices by the top bits of a hash; a slice is merged by one task and has SLICE_BITS bits, unless the slices
#: would be fewer than LEAST_SLICES.
SLICE_BITS, LEAST_SLICES = 1 << 19, 64
#: Keys that a task holds before it gives their filters away.
HELD = 1 << 20


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k) for k in keys], "u8")


def put(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places.ravel() >> 3, np.left_shift(1, places.ravel() & 7).astype("u1"))


@dataclass
class Shape:
    bits: int

    @property
    def slices(self) -> int:
        return max(LEAST_SLICES, self.bits // SLICE_BITS)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The PROBES bits of each hash, all in its slice."""
        each = self.bits // self.slices
        spread = hashes * np.uint64(0x9E3779B97F4A7C15)
        one, two = spread & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
        inside = (one[:, None] + np.arange(PROBES, dtype="u8") * two[:, None]) & np.uint64(each - 1)
        which = spread >> np.uint64(64 - self.slices.bit_length() + 1)
        return (inside + (which * np.uint64(each))[:, None]).astype("i8")

    def filters(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(once, twice) of some keys: what is there, and what is there more than once."""
        own, counts = np.unique(hashes, return_counts=True)
        once, twice = np.zeros((2, self.bits // 8), "u1")
        put(once, self.places(own))
        put(twice, self.places(own[counts > 1]))
        return once, twice


@dataclass
class Filter:
    """The twice-seen filter, or one of given hashes."""

    shape: Shape
    bitmap: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        places = self.shape.places(hashes)
        return (self.bitmap[places >> 3] >> (places & 7) & 1).all(axis=-1)

    def suspects(self, keys: list[bytes]) -> np.ndarray:
        """Which of ``keys`` the filter holds: all that came again, and a few that did not."""
        return self.holds(hashes_of(keys))


def shape_for(keys: int) -> Shape:
    return Shape(min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * keys).bit_length())))


def pack(bitmap: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bitmap.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (slice, once, twice): per slice the filter of what came again. What stands in two filters came again."""
    done: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for s, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            once, twice = unpack(once), unpack(twice)
            if s in done:
                had, again = done[s]
                again |= twice | had & once
                had |= once
            else:
                done[s] = [once.copy(), twice.copy()]
    for s, (_, again) in done.items():
        yield pa.record_batch([pa.array([s], pa.int64()), pa.array([pack(again)], pa.binary())], names=["slice", "bitmap"])


def twice_seen(texts: DataFrame, text: Column, keys_of: Callable[[str], Iterable[bytes]], most: Column) -> Filter:
    """The twice-seen filter over the keys of every text; ``most`` is how many keys a text can have.

    Its size follows the sum of ``most`` between LEAST_BITS and MOST_BITS. Both filters are built where the texts are
    read; only the filters' slices, compressed, are shuffled and merged: twice = twice | twice' | (once & once'). A fuller
    filter suspects more keys; it never misses one that came again.
    """
    keys = texts.agg(F.sum(most.cast("long")).alias("n")).first()["n"] or 0
    shape = shape_for(keys)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(hashes_of([k for value in batch.column(0) for k in keys_of(value.as_py())]))
            n += len(held[-1])
            if n >= HELD:
                yield from sliced(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from sliced(np.concatenate(held))

    def sliced(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from slices_of(shape, *shape.filters(hashes))

    return collected(texts.select(text.alias("text")).mapInArrow(built, PARTS), shape)


#: Slices of the filters of what came once and what came again.
PARTS = "slice bigint, once binary, twice binary"


def slices_of(shape: Shape, once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    once, twice = (f.reshape(shape.slices, -1) for f in (once, twice))
    for s in np.flatnonzero(once.any(axis=1)):
        yield pa.record_batch([pa.array([s], pa.int64()), pa.array([pack(once[s])], pa.binary()), pa.array([pack(twice[s])], pa.binary())], names=["slice", "once", "twice"])


def collected(parts: DataFrame, shape: Shape) -> Filter:
    slices = parts.repartition("slice").mapInArrow(merged, "slice bigint, bitmap binary")
    whole = np.zeros((shape.slices, shape.bits // 8 // shape.slices), "u1")
    for row in slices.collect():  # MOST_BITS bits at most
        whole[row["slice"]] |= unpack(row["bitmap"])
    return Filter(shape, whole.ravel())


def seen(hashes: DataFrame) -> Filter:
    """The filter of a table of one column of 64-bit hashes, which should be cheap to read twice."""
    shape = shape_for(hashes.count())

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(shape.bits // 8, "u1")
        for batch in batches:
            put(own, shape.places(batch.column(0).to_numpy().view("u8")))
        yield from slices_of(shape, own, own)

    return collected(hashes.mapInArrow(built, PARTS), shape)
