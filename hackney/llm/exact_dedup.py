"""Exact duplicates by two passes over hashes of the normalised texts.

The first pass counts the hashes in a Bloom filter whose cells tell once from
twice. The second pass asks it for every row: a row whose hash cannot be
repeated goes straight to the result, and only the others are shuffled, grouped
by the whole SHA-256 and joined with their group.

Texts are equal when they are identical after each run of space, tab, line
feed, vertical tab, form feed and carriage return is made one space. Of equal
texts the row with the smallest doc_id stays; a null doc_id is the smallest.
Of rows that share doc_id and text, one stays. Null texts are empty texts and
equal to each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.llm import sketch
from hackney.llm.common import checkpointed, free_name, text_of

#: Cells per row, hash functions and the largest filter (2**31 cells are 256 MB in a worker).
CELLS_PER_ROW = 16
HASHES = 4
MOST_BITS = 31


def text_digest() -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", " "), 256))


def _head(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    whole = b"".join(digests.to_pylist())
    return np.frombuffer(whole, np.uint64).reshape(-1, 4)[:, 0].copy()


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, keep_id, group_size, kept."""
    rows = checkpointed(docs.select("doc_id", text_digest().alias("digest"), F.monotonically_increasing_id().alias("row")))
    bits = sketch.width_bits(rows.count(), CELLS_PER_ROW, MOST_BITS)
    seen = sketch.repeats(
        rows.select("digest"),
        lambda batches: (_head(batch.column(0)) for batch in batches),
        rows=HASHES,
        bits=bits,
        shared=True,
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = seen.maybe(_head(batch.column("digest")))
            yield batch.append_column("maybe", pa.array(maybe))

    kind = rows.schema["doc_id"].dataType.simpleString()
    asked = checkpointed(rows.mapInArrow(ask, f"doc_id {kind}, digest binary, row long, maybe boolean"))
    alone = asked.filter(~F.col("maybe"))
    shared = asked.filter("maybe")
    # Written once, so that the join below is between two plain exchanges and a hot text can be split.
    repeated = checkpointed(
        shared.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
    )
    joined = shared.join(repeated, "digest", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
    )
    return joined.unionByName(
        alone.select(
            "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
        )
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows that share doc_id and text are told apart by nothing, so of those that
    are to go together with one that stays, one is picked here.
    """
    verdicts = checkpointed(groups(docs))
    mine = free_name(docs, "digest_of_text")
    dropped = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone")).distinct()
    stays = verdicts.filter(F.col("kept") & (F.col("group_size") > 1)).select(
        F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone")
    )
    twins = dropped.intersect(stays)
    here = docs.withColumn(mine, text_digest())
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.col(mine) == F.col("gone"))
    left = here.join(dropped, same, "left_anti")
    once = here.join(twins, same, "left_semi").dropDuplicates(["doc_id", mine])
    return left.unionByName(once).drop(mine)
