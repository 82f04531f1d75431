"""Connected components by alternating large-star and small-star steps.

An edge is kept once, with the larger node first. A large-star step links every
node's larger neighbours to the smallest of the node and its neighbours; a
small-star step does so with the smaller neighbours and the node itself. Each
step is one minimum per node and one join, so no task holds a node's neighbours,
and Spark splits the rows of a node that has very many. When a round of both
changes no edge, every edge leads to the smallest node of its component.

Before the first round each task replaces the edges it has, in blocks of bounded
size, by stars of the components that they make among themselves. That joins the
same nodes, and the rounds start from fewer and shorter paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import checkpointed


#: Edges for which there is one task between two shuffles; a small graph is not dealt over all partitions again and again.
EDGES_PER_TASK = 250_000
#: Edges that a task makes stars of at a time.
BLOCK_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node but the smallest of each component of the links to that smallest node."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[left], root[right]), np.minimum(root[left], root[right])
        if not (high != low).any():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _stars_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        sides = [np.concatenate([batch.column(side).to_numpy(zero_copy_only=False) for batch in held]) for side in ("u", "v")]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in stars(*sides)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(one.num_rows for one in held) >= BLOCK_EDGES:
            yield flush()
    if held:
        yield flush()


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    # u's larger neighbours go to the least of u's neighbourhood.
    return (
        both.join(checkpointed(least.coalesce(tasks)), "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("w").alias("v"))
        .coalesce(tasks)
        .distinct()
    )


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    # Edges lead from the larger to the smaller node.
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("w")).coalesce(tasks))
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u != v").coalesce(tasks)
    return smaller.union(least.select("u", F.col("w").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Differs, but for chance, when the edges do."""
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    )


def connected(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the links (a, b); loops and repeats do no harm."""
    edges = checkpointed(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _mark(edges)
    tasks = 1 + 2 * before[0] // EDGES_PER_TASK
    if before[0]:
        edges = checkpointed(edges.coalesce(tasks).mapInArrow(_stars_of_task, "u long, v long").coalesce(tasks))
        before = _mark(edges)
    while before[0]:
        larger = checkpointed(_large_star(edges, tasks).coalesce(tasks))
        edges = checkpointed(_small_star(larger, tasks).coalesce(tasks))
        after = _mark(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return checkpointed(ends.union(edges.select("v", "v").toDF("node", "component")).distinct().coalesce(tasks))
