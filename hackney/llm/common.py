"""Helpers that the operators of this package share.

Rules for rows that hold for every operator: a null text is an empty text, a
null `doc_id` is kept as null and orders before every number, rows that share a
`doc_id` are ordered by a hash of their text, and rows that share both stand
for the same place. Only the two columns are read, so other columns of any
name do no harm.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time.
CHUNK_BYTES = 2 << 20
#: Stands for a null doc_id where ids are packed into arrays.
NULL_ID = -(1 << 63)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where all work runs in this process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hackney-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; a null text is empty."""
    return docs.select(F.col("doc_id"), text_of().alias("text"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the two numbers that order and name a row: key and tie."""
    return texts(docs).select("doc_id", "text", key_of().alias("key"), F.xxhash64("text").alias("tie"))


def key_of() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose key and tie are not among those of `gone`."""
    key, tie = free_name(docs, "row_key"), free_name(docs, "row_tie")
    gone = gone.select(F.col("key").alias(key + "_gone"), F.col("tie").alias(tie + "_gone"))
    rows = docs.withColumn(key, key_of()).withColumn(tie, F.xxhash64(text_of()))
    same = (F.col(key) == F.col(key + "_gone")) & (F.col(tie) == F.col(tie + "_gone"))
    return rows.join(gone, same, "left_anti").drop(key, tie)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(frame: DataFrame, least: int = 1) -> int:
    return max(least, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with about `most` bytes of text, and at least one row, each.

    Each comes with the bytes of its texts in one array and the offsets of the
    texts in it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("text").cast(pa.large_binary())
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(column):
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), len(column))
            first, last = int(offsets[start]), int(offsets[end])
            yield batch.slice(start, end - start), data[first:last], offsets[start : end + 1] - first
            start = end


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit numbers over all bits; a bijection for each seed."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, length: int) -> np.ndarray:
    """base**0, base**1, ... as 64-bit numbers; grown as longer ones are asked for."""
    known = _POWERS.get(base)
    if known is None or len(known) < length:
        size = max(length, 1 << 16, 0 if known is None else 2 * len(known))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:length]


class Ranges:
    """Polynomial hashes of any ranges of one sequence, from its running sums."""

    def __init__(self, values: np.ndarray, base: int):
        self.back = powers(pow(base, -1, 1 << 64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
        """Of the values in [start, end); equal ranges have equal hashes, in this and in other sequences."""
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts], seed)

    def neighbours(self, width: int) -> np.ndarray:
        """Of every `width` values that follow each other, as they are: equal ones for equal values, but not spread over all bits."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.back[: len(out)]
        return out
