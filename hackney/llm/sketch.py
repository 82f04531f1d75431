"""Counters of hashes that stop at two, merged over all partitions.

Each hash has one cell in each of several rows of cells. A task sends the cells
that its hashes hit, sorted, each at most twice, as byte differences. The cells
of a block are then added up one message at a time. What is left is one bit per
cell: hit twice or more. A hash that occurs twice has that bit in every row, so
`Repeats.maybe` never misses one; others pass by chance, the more often the
fuller the cells are.

The bits are what every worker gets. Their number follows the number of hashes
up to a bound that the caller states; beyond it more hashes pass by chance, and
the exact pass that follows has more to do, but nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hackney.llm.common import mix, partitions_for

_BLOCK_BITS = 20
_MEMBER_HASHES = 4
_FLUSH = 1 << 22


def width_bits(hashes: int, per_hash: int, most_bits: int) -> int:
    """log2 of the cells in a row, for a number of hashes."""
    return min(max(_BLOCK_BITS, int(max(1, hashes * per_hash - 1)).bit_length()), most_bits)


def _cells(hashes: np.ndarray, row: int, bits: int, shared: bool) -> np.ndarray:
    cell = mix(hashes, row + 1) >> np.uint64(64 - bits)
    return cell if shared else cell + np.uint64(row << bits)


def _packed(offsets: np.ndarray) -> bytes:
    """Sorted numbers as differences; 255 stands for a step without a number."""
    gaps = np.diff(offsets, prepend=0)
    skips = gaps // 255
    out = np.full(int(skips.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(skips + 1) - 1] = gaps % 255
    return out.tobytes()


def _unpacked(message: bytes) -> np.ndarray:
    steps = np.frombuffer(message, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _messages(hashes: list[np.ndarray], rows: int, bits: int, shared: bool) -> pa.RecordBatch:
    values = np.concatenate(hashes)
    cells = np.concatenate([_cells(values, row, bits, shared) for row in range(rows)]).astype(np.int64)
    cells.sort()
    third = np.zeros(len(cells), bool)
    third[2:] = cells[2:] == cells[:-2]
    cells = cells[~third]
    blocks = cells >> _BLOCK_BITS
    starts = np.flatnonzero(np.diff(blocks, prepend=-1))
    parts = np.split(cells & ((1 << _BLOCK_BITS) - 1), starts[1:])
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks[starts], pa.int32()), pa.array([_packed(part) for part in parts], pa.binary())],
        names=["block", "cells"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block that has a cell hit twice; its messages come one after the other."""
    now, seen, twice = None, None, None

    def bits() -> Iterator[pa.RecordBatch]:
        if now is not None and twice.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
                names=["block", "bits"],
            )

    for batch in batches:
        for block, message in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if block != now:
                yield from bits()
                now, seen, twice = block, np.zeros(1 << _BLOCK_BITS, bool), np.zeros(1 << _BLOCK_BITS, bool)
            cells = _unpacked(message)
            twice[cells[1:][cells[1:] == cells[:-1]]] = True
            twice[cells[seen[cells]]] = True
            seen[cells] = True
    yield from bits()


class Repeats:
    """Which hashes may occur more than once; held by every worker."""

    def __init__(self, rows: int, bits: int, shared: bool, hit_twice):
        self.rows, self.bits, self.shared, self._hit_twice = rows, bits, shared, hit_twice

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether it may be a repeated one."""
        array = np.frombuffer(self._hit_twice.value, np.uint8)
        left = np.arange(len(hashes))
        for row in range(self.rows):
            cell = _cells(hashes[left], row, self.bits, self.shared)
            hit = (array[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1
            left = left[hit == 1]
        found = np.zeros(len(hashes), bool)
        found[left] = True
        return found


def repeats(
    frame: DataFrame,
    hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]],
    *,
    rows: int,
    bits: int,
    shared: bool = False,
) -> Repeats:
    """Counts the hashes that `hashes_of` makes of the frame's batches.

    `rows` cells per hash; with `shared` they lie in one array of 2**bits cells
    (a Bloom filter), else in a row of that size each (a count-min sketch).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for hashes in hashes_of(batches):
            held.append(hashes)
            count += len(hashes)
            if count >= _FLUSH:
                yield _messages(held, rows, bits, shared)
                held, count = [], 0
        if count:
            yield _messages(held, rows, bits, shared)

    sent = frame.mapInArrow(send, "block int, cells binary")
    merged = (
        sent.repartition(partitions_for(frame), "block")
        .sortWithinPartitions("block")
        .mapInArrow(_merged, "block int, bits binary")
    )
    array = bytearray((1 if shared else rows) << (bits - 3))
    size = 1 << (_BLOCK_BITS - 3)
    for row in merged.toLocalIterator():
        array[row["block"] * size : (row["block"] + 1) * size] = row["bits"]
    # As bytes, a worker reads it without a second copy.
    return Repeats(rows, bits, shared, frame.sparkSession.sparkContext.broadcast(bytes(array)))


def members(frame: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], *, bits: int) -> Repeats:
    """A filter that `maybe` passes all hashes of the frame, and others by chance: each is counted twice."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for hashes in hashes_of(batches):
            yield np.concatenate([hashes, hashes])

    return repeats(frame, twice, rows=_MEMBER_HASHES, bits=bits, shared=True)
