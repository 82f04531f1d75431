"""Joins marks of documents with their texts, and shuffles only the texts that may have some.

The keys of the marked documents go into a Bloom filter of bounded size that all
workers get. A text that it rules out is worked on where it is read; the others,
among them all marked ones, are shuffled to their marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hackney.llm import sketch
from hackney.llm.common import checkpointed, keyed_texts, mix, slices

#: Cells of the filter per marked document, and log2 of the most cells.
CELLS_PER_DOCUMENT = 16
MOST_BITS = 31

Batches = Iterator[pa.RecordBatch]

#: A row holds the marks of many documents of one group: how many each has, one after the other.
PACKED = "group int, keys binary, ties binary, counts binary, marks binary"
_KINDS = [pa.int32(), *[pa.binary()] * 4]


def packed(keys: np.ndarray, ties: np.ndarray, marks: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows of marks, a row per group of documents. Marks of a document must be neighbours; each is one or more numbers.

    The group follows from key and tie, so documents of one id are in all groups.
    """
    rows: list[list] = [[] for _ in _KINDS]
    group = (_hashed(keys, ties) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    keys, ties, marks, group = keys[order], ties[order], marks[order], group[order]
    edges = np.flatnonzero(np.diff(group)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(group)], strict=True) if len(group) else ():
        own, tie = keys[start:end], ties[start:end]
        first = np.flatnonzero(np.append(True, (np.diff(own) != 0) | (np.diff(tie) != 0)))
        counts = np.diff(first, append=end - start).astype(np.uint32)
        values = [int(group[start]), own[first].tobytes(), tie[first].tobytes(), counts.tobytes(), marks[start:end].tobytes()]
        for column, value in zip(rows, values, strict=True):
            column.append(value)
    arrays = [pa.array(column, kind) for column, kind in zip(rows, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["group", "keys", "ties", "counts", "marks"])


def _unpacked(table: pa.Table) -> pa.Table:
    """A row per document and message, of a group's rows."""
    keys, ties, marks = [], [], []
    for row in table.to_pylist():
        keys.append(np.frombuffer(row["keys"], np.int64))
        ties.append(np.frombuffer(row["ties"], np.int64))
        counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        size = len(row["marks"]) // max(1, int(counts.sum()))
        ends = np.cumsum(counts) * size
        marks += [row["marks"][a:b] for a, b in zip((ends - counts * size).tolist(), ends.tolist(), strict=True)]
    keys, ties = np.concatenate(keys), np.concatenate(ties)
    order = np.lexsort((ties, keys))
    new = np.flatnonzero(np.append(True, (np.diff(keys[order]) != 0) | (np.diff(ties[order]) != 0)))
    joined = [b"".join([marks[i] for i in part]) for part in np.split(order, new[1:])]
    return pa.table(
        [pa.array(keys[order[new]]), pa.array(ties[order[new]]), pa.array(joined, pa.binary())], names=["key", "tie", "marks"]
    )


def _hashed(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """One number for key and tie."""
    return mix(keys.view(np.uint64) ^ mix(ties.view(np.uint64), 3), 4)


def _names(batch: pa.RecordBatch) -> np.ndarray:
    return _hashed(*(batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "tie")))


def with_marks(docs: DataFrame, marked: DataFrame, work: Callable[[Batches], Batches], columns: str) -> DataFrame:
    """What `work` makes of batches of doc_id, text and marks, of every row of `docs`.

    `marked` has rows of `PACKED`; a document's marks come in one string of
    bytes, in any order, which is null if there is none.
    """
    one = marked.groupBy("group").applyInArrow(_unpacked, "key long, tie long, marks binary")
    marks = checkpointed(one)
    bits = sketch.width_bits(marks.count(), CELLS_PER_DOCUMENT, MOST_BITS)
    some = sketch.members(marks.select("key", "tie"), lambda batches: map(_names, batches), bits=bits)

    def here(batches: Batches) -> Batches:
        def unmarked() -> Batches:
            for batch, _, _ in slices(batches):
                rest = batch.filter(pa.array(~some.maybe(_names(batch))))
                yield pa.RecordBatch.from_arrays(
                    [rest.column("doc_id"), rest.column("text"), pa.nulls(rest.num_rows, pa.binary())], names=["doc_id", "text", "marks"]
                )

        yield from work(unmarked())

    def there(batches: Batches) -> Batches:
        for batch, _, _ in slices(batches):
            yield batch.filter(pa.array(some.maybe(_names(batch))))

    rows = keyed_texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.mapInArrow(there, f"doc_id {kind}, text string, key long, tie long")
    joined = sent.join(marks, ["key", "tie"], "left").select("doc_id", "text", "marks")
    schema = f"doc_id {kind}, {columns}"
    return rows.mapInArrow(here, schema).unionByName(joined.mapInArrow(work, schema))
