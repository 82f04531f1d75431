"""Near-duplicate documents by MinHash, with links confirmed on whole sets.

A document's set holds its runs of `SHINGLE` words, A to Z in lower case; a
shorter one has one run of all its words, one without words has none and links
to nothing. Documents with equal sets are one class, and one of them stands for
all. Two classes are linked when the sets share `percent` of their union or more;
`PERCENT` unless told otherwise, and one of `LIMITS`.

1. Each set gets `HASHES` minima under universal hashes. Those of a band,
   hashed together, are the band's bucket.
2. In every bucket all members are paired with the first one.
3. Pairs whose minima agree too seldom for a link are dropped, the others are
   confirmed on the whole sets, and the links joined to components by alternating
   large-star and small-star steps.
4. Documents that meet in a bucket, directly or through others, are a cluster. Two
   of a cluster that are in different components were perhaps not compared yet.
   Those outside the cluster's largest component are compared with the others, by
   their minima and then by their whole sets, block by block of bounded size. A
   task reports only links that join components it has not seen joined, and the
   components are made anew.

Steps 2 and 4 together look at every pair of a bucket whose two members may be
in different components, so no link between components is lost; links within a
component change nothing and are not looked for. A cluster of which one link
holds most members together takes time in proportion to its size; one that
falls apart into many components that only just miss a link takes more.

Rows that share doc_id and text are one document, a null doc_id is the smallest.
Null and empty texts have no words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import NULL_ID, checkpointed, keyed_texts, mix, slices, without_rows
from hackney.llm.components import connected
from hackney.llm.words import Words, lowered, run_hashes, window_starts

SHINGLE = 5
PERCENT = 85
HASHES = 192


class Limits(NamedTuple):
    """What the minima of a set are used for; follows from the least similarity of a link."""

    percent: int
    bands: int
    rows: int
    least_agreeing: int


#: By percent. A pair just at the limit misses all bands of 0.85 once in 3.8 million times, and those of 0.8 once in 3.6 million.
#: It agrees in fewer minima once in 660 million times at 0.85 and once in a thousand million at 0.8, so the bands lose most.
LIMITS = {limits.percent: limits for limits in (Limits(85, 32, 6, 131), Limits(80, 38, 5, 118))}
#: Rows that a task compares the members of a bucket with at a time.
BLOCK = 1024
#: Ids that are broadcast at most; 16 bytes each.
BROADCAST_ROWS = 2_000_000

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, HASHES, np.uint64)
_PART = 1 << 15  # shingles whose minima are taken at a time, to stay in a core's cache


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other; and how many each has."""
    words = Words(lowered(data), offsets)
    hashes = words.hashes()
    starts, owner = window_starts(words.first, words.counts, SHINGLE)
    few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    ends = np.concatenate([starts + SHINGLE, words.first[few + 1]])
    found = run_hashes(hashes, np.concatenate([starts, words.first[few]]), ends)
    owner = np.concatenate([owner, few])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=len(offsets) - 1)


def minima(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least value of each universal hash over each set; sets must not be empty."""
    out = np.empty((len(counts), HASHES), np.uint64)
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        base = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + _PART, "right")))
        values, starts = sets[base : ends[high - 1]], (ends - counts)[low:high] - base
        hashed = np.empty_like(values)
        for i in range(HASHES):
            np.multiply(values, _FACTORS[i], out=hashed)
            hashed += _TERMS[i]
            out[low:high, i] = np.minimum.reduceat(hashed, starts)
        low = high
    return out


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for the minima of each band."""
    grouped = least[:, : bands * rows].reshape(len(least), bands, rows)
    out = np.zeros((len(least), bands), np.uint64)
    for row in range(rows):
        out = mix(out ^ grouped[:, :, row], row)
    return out


def _signed(limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_shingles, a digest of the set, band hashes and 16 bits of each minimum, of every row."""
    for batch, data, offsets in slices(batches):
        sets, counts = shingle_sets(data, offsets)
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        digests, bands, signatures = ([None] * batch.num_rows for _ in range(3))
        if len(some):
            sums = [np.add.reduceat(mix(sets, seed), starts) for seed in (11, 12)]
            least = minima(sets, counts[some])
            hashed, short = band_hashes(least, limits.bands, limits.rows), mix(least, 13).astype(np.uint16)
            for place, row in enumerate(some.tolist()):
                digests[row] = sums[0][place].tobytes() + sums[1][place].tobytes() + int(counts[row]).to_bytes(4, "little")
                bands[row] = hashed[place].astype(np.int64)
                signatures[row] = short[place].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in ("doc_id", "key", "tie")),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(signatures, pa.binary()),
            ],
            names=["doc_id", "key", "tie", "n_shingles", "digest", "bands", "signature"],
        )


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches):
        sets, counts = shingle_sets(data, offsets)
        parts = np.split(sets, np.cumsum(counts)[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([part.tobytes() for part in parts], pa.binary())], names=["node", "shingles"]
        )


def _agreeing(limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough for a link."""
    for batch in batches:
        if batch.num_rows:
            a, b = (
                np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, HASHES)
                for name in ("a_signature", "b_signature")
            )
            fits = (a == b).sum(1) >= limits.least_agreeing
            yield batch.select(["a", "b"]).filter(pa.array(fits))


def _linked(limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("a_shingles"), batch.column("b_shingles"), strict=True):
            a, b = (np.frombuffer(side.as_buffer(), np.uint64) for side in (left, right))
            keep.append(_similar(a, b, limits.percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare_block(limits: Limits) -> Callable[[pa.Table], pa.Table]:
    """Links that join components, between the block's guests and its own rows."""

    def run(table: pa.Table) -> pa.Table:
        node, part = table.column("node").to_numpy(), table.column("component").to_numpy()
        guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(value.as_buffer(), np.uint64) for value in table.column("shingles")]
        sizes = np.array([len(one) for one in sets])
        own = np.flatnonzero(~guest)
        name = {component: i for i, component in enumerate(np.unique(part).tolist())}
        group = np.array([name[component] for component in part.tolist()])  # components that links found here have joined
        links = []
        for row in np.flatnonzero(guest):
            others = own[group[own] != group[row]]
            least, most = np.minimum(sizes[others], sizes[row]), np.maximum(sizes[others], sizes[row])
            others = others[100 * least >= limits.percent * most]
            agreeing = (signatures[others] == signatures[row]).sum(1)
            likely = agreeing >= limits.least_agreeing
            for other in others[likely][np.argsort(-agreeing[likely], kind="stable")]:
                if group[other] != group[row] and _similar(sets[row], sets[other], limits.percent):
                    links.append((int(node[row]), int(node[other])))
                    group[group == group[other]] = group[row]
        return pa.table(
            [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"]
        )

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles (packed) of the wanted (node, key, tie); made again from the texts."""
    wanted = checkpointed(wanted)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = keyed_texts(docs).select("key", "tie", "text").join(wanted, ["key", "tie"]).dropDuplicates(["node"])
    return checkpointed(rows.select("node", "text").mapInArrow(_packed_sets, "node long, shingles binary"))


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, limits: Limits) -> DataFrame:
    """The pairs that are links."""
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets_of(docs, wanted.join(nodes.select("node", "key", "tie"), "node"))
    # Both sides of each join are read from files, so that Spark can split the rows of a node with many pairs.
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_shingles"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "a_shingles", "b_shingles")
    return checkpointed(both.mapInArrow(partial(_linked, limits), "a long, b long"))


def _rest(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, parts: DataFrame, limits: Limits) -> DataFrame:
    """Links between components of a cluster, from its members outside the largest component."""
    named = (
        clusters.withColumnRenamed("component", "cluster")
        .join(parts, "node", "left")
        .select("cluster", "node", F.coalesce("component", "node").alias("component"))
    )
    sizes = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")
    )
    split = checkpointed(
        split.filter("parts > 1").select(
            "cluster",
            F.col("largest.component").alias("largest"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int").alias("guest_blocks"),
        )
    )
    open_ = checkpointed(named.join(split, "cluster").join(nodes.select("node", "key", "tie", "signature"), "node"))
    sets = _sets_of(docs, open_.select("node", "key", "tie"))
    open_ = open_.drop("key", "tie").join(sets, "node")
    columns = ["node", "component", "signature", "shingles"]
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    place = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    own = open_.select("cluster", place("blocks").alias("block"), each("guest_blocks").alias("guests"), F.lit(False).alias("guest"), *columns)
    guests = open_.filter("component != largest").select(
        "cluster", each("blocks").alias("block"), place("guest_blocks").alias("guests"), F.lit(True).alias("guest"), *columns
    )
    rows = own.unionByName(guests)
    return checkpointed(rows.groupBy("cluster", "block", "guests").applyInArrow(_compare_block(limits), "a long, b long"))


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, key, tie, n_shingles, and the key and tie of the first document of its component."""
    limits = LIMITS[percent]
    signed = keyed_texts(docs).mapInArrow(
        partial(_signed, limits),
        f"doc_id {dict(keyed_texts(docs).dtypes)['doc_id']}, key long, tie long, n_shingles long, digest binary, "
        "bands array<long>, signature binary",
    )
    signed = checkpointed(signed)
    classes = (
        signed.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("key", "tie", "bands", "signature")).alias("first"))
        .select("digest", "first.*", F.monotonically_increasing_id().alias("node"))
    )
    classes = checkpointed(classes)
    banded = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    firsts = banded.groupBy("band", "bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members"))
    shared = checkpointed(firsts.filter("members > 1"))
    members = banded.join(shared, ["band", "bucket"]).select("node", "a")
    signatures = classes.select("node", "signature")
    of = lambda side: signatures.select(F.col("node").alias(side), F.col("signature").alias(f"{side}_signature"))
    to_first = checkpointed(members.filter("node != a").select("a", F.col("node").alias("b")).distinct())
    near = to_first.join(of("b"), "b").join(of("a"), "a").mapInArrow(partial(_agreeing, limits), "a long, b long")
    links = _confirmed(near, docs, classes, limits)
    parts = connected(links)

    # Every node with its component joins what the links do, with fewer edges.
    found = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = connected(found.unionByName(_rest(docs, classes, connected(to_first), parts, limits)))

    whole = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = whole.groupBy("component").agg(F.min(F.struct("key", "tie")).alias("first"))
    named = checkpointed(
        whole.join(checkpointed(first), "component").select(
            "digest", F.col("first.key").alias("first_key"), F.col("first.tie").alias("first_tie")
        )
    )
    rows = signed.select("doc_id", "key", "tie", "n_shingles", "digest")
    none = rows.filter("n_shingles = 0").select(
        "doc_id", "key", "tie", "n_shingles", F.col("key").alias("first_key"), F.col("tie").alias("first_tie")
    )
    return rows.filter("n_shingles > 0").join(named, "digest").drop("digest").unionByName(none)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    first = F.when(F.col("first_key") != NULL_ID, F.col("first_key"))
    return components(docs).select(
        "doc_id", "n_shingles", first.alias("component_id"), F.col("doc_id").eqNullSafe(first).alias("kept")
    )


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of the first document of each component, with all their columns."""
    same = (F.col("key") == F.col("first_key")) & (F.col("tie") == F.col("first_tie"))
    return without_rows(docs, checkpointed(components(docs, percent).filter(~same).select("key", "tie").distinct()))
