"""Repeated runs of words, by a count-min prefilter and an exact second pass.

A window is `WINDOW` neighbouring words of one text. The first pass counts the
windows' hashes in a sketch that is merged over all tasks and never counts too
little. The second pass goes on with the windows that the sketch counts twice
or more, and groups them exactly. In every piece of a task's input the repeats
within the piece are settled on the spot, and only the first occurrence of a
window is sent, so a window that most documents share sends a row per piece.
Of the occurrences sent, all but the first in order are repeats.

Every word that a repeat covers is removed; windows are judged on the input.
Occurrences are ordered by doc_id (null first), then a hash of the text, then
start; rows that share doc_id and text are one place and do not repeat each
other. Null and empty texts have no words. An empty table gives an empty result.

Windows are told apart by 96 bits of two hashes, made of two hashes of each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm import sketch
from hackney.llm.common import keyed_texts, partitions_for, slices, texts
from hackney.llm.marks import PACKED, packed, with_marks
from hackney.llm.words import Words, run_hashes, window_starts

WINDOW = 20
#: The sketch: rows, cells per byte of text in each, and log2 of the most cells of a row.
SKETCH_ROWS = 2
CELLS_PER_BYTE = 0.5
MOST_BITS = 30
#: Bytes of text for which there is one group of windows to compare in the second pass.
BYTES_PER_GROUP = 16 << 20

# Marks that are settled already travel with the windows, in rows without hashes.
_SENT = "bucket int, hash binary, more binary, doc binary, place binary, keys binary, ties binary, counts binary, marks binary"
_NAMES = [column.split()[0] for column in _SENT.split(", ")]


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _windows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int):
    words = Words(data, offsets)
    hashes = words.hashes()
    starts, owner = window_starts(words.first, words.counts, width)
    return hashes, starts, owner, words


def window_hashes(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch, data, offsets in slices(batches):
            hashes, starts, _, _ = _windows(batch, data, offsets, width)
            yield run_hashes(hashes, starts, starts + width)

    return run


def first_of_equal(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows with equal keys are neighbours and keep their order, and which of it is the first of its kind."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        ordered = key[order]
        same &= ordered[1:] == ordered[:-1]
    first[1:] = ~same
    return order, first


def by_place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ties of the rows, and each row's rank among them; equal rows share a rank."""
    keys = batch.column("key").to_numpy(zero_copy_only=False)
    ties = batch.column("tie").to_numpy(zero_copy_only=False)
    order = np.lexsort((ties, keys))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(ties[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return keys, ties, rank


def message(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row.get(name) for row in rows], kind) for name, kind in zip(names, kinds, strict=True)], names=names
    )


def settled_rows(keys: np.ndarray, ties: np.ndarray, marks: np.ndarray, buckets: int) -> list[dict]:
    """Marks in rows of a task's message; a group's row goes to the bucket of the group's number."""
    return [{"bucket": row["group"], **row} for row in packed(keys, ties, marks, buckets).to_pylist()]


_KINDS = [pa.int32(), *[pa.binary()] * 8]


def _send(repeats: sketch.Repeats, width: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First occurrences of the windows that may be repeated, by bucket; and repeats within a piece, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            hashes, starts, owner, words = _windows(batch, data, offsets, width)
            hash_ = run_hashes(hashes, starts, starts + width)
            picked = np.flatnonzero(repeats.maybe(hash_))
            if not len(picked):
                continue
            keys, ties, rank = by_place(batch)
            starts, owner, hash_ = starts[picked], owner[picked], hash_[picked]
            place = starts - words.first[owner]
            at = np.lexsort((place, rank[owner]))
            starts, owner, hash_, place = starts[at], owner[at], hash_[at], place[at]
            more = run_hashes(words.hashes(1), starts, starts + width, 1).astype(np.uint32)
            order, first = first_of_equal([hash_, more])
            # A row that is there twice is one place.
            leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            again = ~first & ~((rank[owner[order]] == rank[owner[leader]]) & (place[order] == place[leader]))
            rows = []
            later = np.sort(order[again])
            row = owner[later]
            rows += settled_rows(keys[row], ties[row], place[later].astype(np.uint32), buckets)
            own = order[first]
            bucket = (hash_[own] >> np.uint64(32)).astype(np.int64) * buckets >> 32
            for start, end in runs_of(bucket):
                part = own[start:end]
                rows_, doc = np.unique(owner[part], return_inverse=True)
                rows.append(
                    {
                        "bucket": int(bucket[start]),
                        "hash": hash_[part].tobytes(),
                        "more": more[part].tobytes(),
                        "doc": doc.astype(np.uint32).tobytes(),
                        "place": place[part].astype(np.uint32).tobytes(),
                        "keys": keys[rows_].tobytes(),
                        "ties": ties[rows_].tobytes(),
                    }
                )
            yield message(rows, _NAMES, _KINDS)

    return run


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if len(values):
        edges = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)


def settled_part(table: pa.Table) -> pa.Table:
    """The rows of a bucket that are settled already."""
    passed = table.filter(pa.compute.is_valid(table.column("counts")))
    return passed.select(["bucket", "keys", "ties", "counts", "marks"]).rename_columns(["group", "keys", "ties", "counts", "marks"])


def _settle(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """All occurrences of a bucket but the first of each window; settled ones pass."""

    def run(table: pa.Table) -> pa.Table:
        passed = settled_part(table)
        sent = table.filter(pa.compute.is_valid(table.column("hash")))
        if not sent.num_rows:
            return passed

        def column(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(value, kind) for value in sent.column(name).to_pylist()]

        docs = column("doc", np.uint32)
        key = np.concatenate([keys[doc] for keys, doc in zip(column("keys", np.int64), docs, strict=True)])
        tie = np.concatenate([ties[doc] for ties, doc in zip(column("ties", np.int64), docs, strict=True)])
        hash_, more = np.concatenate(column("hash", np.uint64)), np.concatenate(column("more", np.uint32))
        place = np.concatenate(column("place", np.uint32))
        by = np.lexsort((place, tie, key))
        key, tie, hash_, more, place = key[by], tie[by], hash_[by], more[by], place[by]
        order, first = first_of_equal([hash_, more])
        leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        same = (key[order] == key[leader]) & (tie[order] == tie[leader]) & (place[order] == place[leader])
        later = np.sort(order[~first & ~same])
        found = packed(key[later], tie[later], place[later], buckets)
        return pa.concat_tables([passed, pa.Table.from_batches([found])])

    return run


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Packed first words of windows that also start earlier."""
    rows = keyed_texts(docs).select("key", "tie", "text")
    size = text_bytes(rows)
    bits = sketch.width_bits(int(size * CELLS_PER_BYTE), 1, MOST_BITS)
    counted = sketch.repeats(texts(docs).select("text"), window_hashes(width), rows=SKETCH_ROWS, bits=bits)
    buckets = max(partitions_for(docs), size // BYTES_PER_GROUP + 1)
    sent = rows.mapInArrow(_send(counted, width, buckets), _SENT)
    return sent.groupBy("bucket").applyInArrow(_settle(buckets), PACKED)


def kept_words(docs: DataFrame, width: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space (or the SHA-256 of that) of every row."""
    name = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            words = Words(data, offsets)
            removed = np.zeros(len(words.starts) + 1, np.int64)
            for i, marks in enumerate(batch.column("marks").to_pylist()):
                if marks:
                    at = np.frombuffer(marks, np.uint32).astype(np.int64) + words.first[i]
                    np.add.at(removed, at, 1)
                    np.subtract.at(removed, at + width, 1)
            gone = np.cumsum(removed)[:-1] > 0
            kept, lost = [], []
            raw = data.tobytes()
            for first, last in zip(words.first[:-1], words.first[1:], strict=True):
                stay = np.flatnonzero(~gone[first:last]) + first
                lost.append(int(last - first - len(stay)))
                text = b" ".join([raw[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist())])
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", name],
            )

    return with_marks(docs, repeated_windows(docs, width), run, f"n_words long, n_removed long, {name} string")
