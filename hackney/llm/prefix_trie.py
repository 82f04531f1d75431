"""Prefix trie of conversations, rolled up by centroid decomposition.

`rebuilt` gives every conversation the opening turns that it shares with others,
`trie` makes one node of each distinct opening sequence of turns and rolls up,
over each node's subtree, the number of leaves and the characters that sharing
the turns saves.

A node's name is the exclusive or of hashes of (place, turn) over its turns, 128
bits made of SHA-256 digests; it follows from the name of the node above without
the turns between. Numbers and names of turns are running values over rows that
are ordered by range, so that a conversation with very many turns lies on many
tasks, and only each task's last value goes through the driver.

The forest of parent edges is split by weight, an upper bound of a subtree's
nodes that follows from the members: whole subtrees of `PIECE` nodes at most, and
above them the nodes of heavier subtrees, which are cut into bands of depth when
there are many. Each part is rolled up in a task by centroid decomposition: the
centroid of a component splits it, the totals of the split parts are added up,
and what hangs on the centroid is added along the path from it to the
component's top. Parts that hang on others hand them their totals.

Turns are ordered by number, null first; turns with the same number by a digest
of role and text, and repeated rows are turns of their own. A null role or text is
empty. A turn without a conv_id is of no conversation and left out. A conversation
without turns is a member of the root alone. Texts of any length count whole;
only their digests and lengths are shuffled. An empty table gives an empty result.
Only the columns conv_id, turn, role and text are read, so others of any name do
no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import checkpointed

#: Most nodes of a subtree that is rolled up whole, and about the most nodes of a band.
PIECE = 1 << 16
BAND = 1 << 20
#: A key with more than one in so many rows is looked up by broadcast; there are fewer of them.
HOT = 1000
#: Conversations whose ids agree but for so many low bits are listed together for a node's digest.
BLOCK_BITS = 16


def _root() -> tuple[Column, Column]:
    """The name of the node without turns."""
    return F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, content (a digest of role and text) and chars of every turn."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(content).alias("content"),
        F.char_length(text).cast("long").alias("chars"),
    ).filter(F.col("conv_id").isNotNull())


def _running(frame: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for every row, its number in its conversation and the exclusive or of columns so far.

    The rows are spread by range of conversation and order. What a conversation
    has in earlier partitions is added from one row per partition.
    """
    inputs, outputs = list(sums.values()), list(sums)

    def locally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, carried = None, 0, dict.fromkeys(outputs, 0)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.concatenate(([ids[0] != last], ids[1:] != ids[:-1])))
            begin = np.zeros(rows, np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            goes_on = begin == 0 if ids[0] == last else np.zeros(rows, bool)
            number = np.arange(rows) - begin + 1 + np.where(goes_on, count, 0)
            columns = [pa.array(np.full(rows, part, np.int32)), pa.array(number)]
            for name, source in zip(outputs, inputs, strict=True):
                so_far = np.concatenate(([0], np.bitwise_xor.accumulate(batch.column(source).to_numpy())))
                value = so_far[1:] ^ so_far[begin] ^ np.where(goes_on, carried[name], 0)
                carried[name] = int(value[-1])
                columns.append(pa.array(value))
            last, count = ids[-1], int(number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "n", *outputs])

    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in frame.schema)
    kinds += "".join(f", {name} {kind}" for name, kind in [("part", "int"), ("n", "long"), *((name, "long") for name in outputs)])
    ordered = frame.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    local = checkpointed(ordered.mapInArrow(locally, kinds))
    ends = local.groupBy("part").agg(
        F.min("conv_id").alias("low"), F.max(F.struct("conv_id", "n", *outputs)).alias("last")
    )
    before, offsets, state = None, [], None
    for row in sorted(ends.collect(), key=lambda row: row.part):
        low, last = row.low, row.last
        if low == before:
            offsets.append((row.part, low, *state))
        value = (last.n, *(last[name] for name in outputs))
        if last.conv_id == before:  # the whole partition is of the conversation that goes on
            value = (state[0] + value[0], *(x ^ y for x, y in zip(state[1:], value[1:], strict=True)))
        before, state = last.conv_id, value
    names = ["n", *outputs]
    schema = "part int, conv_id long, " + ", ".join(f"_{name} long" for name in names)
    known = frame.sparkSession.createDataFrame(offsets, schema)
    joined = local.join(F.broadcast(known), ["part", "conv_id"], "left")
    added = {"n": F.col("n") + F.coalesce("_n", F.lit(0))}
    added |= {name: F.col(name).bitwiseXOR(F.coalesce(f"_{name}", F.lit(0))) for name in outputs}
    return joined.withColumns(added).drop("part", *(f"_{name}" for name in names))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Inner join to a table with one row per key; the few `hot` keys by broadcast, so that none fills a task."""
    hot = F.broadcast(hot.select(*keys))
    of_hot = rows.join(F.broadcast(table.join(hot, keys, "left_semi")), keys)
    return of_hot.unionByName(rows.join(hot, keys, "left_anti").join(table.join(hot, keys, "left_anti"), keys))


def _is_hot(count: str, total: int) -> Column:
    """Holds for fewer than `HOT` keys, if the counts of all keys are `total` rows."""
    return F.col(count) * HOT > total


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations, and one row per conversation with its length.

    Conversation c is rebuilt of the first h turns of the conversation that
    opens its group of `group` ids and its own turns after its first h, h being
    the CRC of its id modulo `most` + 1. Turns have conv_id, depth, content,
    chars and length.
    """
    numbered = _running(turns_of(conversations), ["turn", "content"], {}).drop("turn")
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    heads = numbered.filter((F.col("conv_id") % group == 0) & (F.col("n") <= most)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("n", "content", "chars"))).alias("head"))
    own = numbered.groupBy("conv_id").agg(F.max("n").alias("own"))
    plan = (
        own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "opening": opening.cast("int")})
        .join(heads, "base", "left")
        .withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("opening"))))
        .withColumn("taken", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
        .withColumn("taken", F.greatest("taken", F.lit(0).cast("long")))
        .withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("opening"), F.lit(0)))
    )
    plan = checkpointed(plan.select("conv_id", "own", "opening", "taken", "length", "head"))
    total = plan.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    opened = plan.select("conv_id", "length", F.explode("head").alias("turn")).select(
        "conv_id", F.col("turn.n").alias("depth"), "turn.content", "turn.chars", "length"
    )
    shifts = plan.select("conv_id", "taken", "length", "opening")
    rest = numbered.filter(F.col("n") > opening)
    rest = _looked_up(rest, shifts, ["conv_id"], plan.filter(_is_hot("own", total)))
    rest = rest.select("conv_id", (F.col("n") - F.col("opening") + F.col("taken")).alias("depth"), "content", "chars", "length")
    return opened.unionByName(rest), plan.select("conv_id", "length")


def _levels(up: np.ndarray) -> list[np.ndarray]:
    """Nodes by their distance from the top of their component; `up` has the node above, or -1."""
    found = [np.flatnonzero(up == -1)]
    children = np.argsort(up, kind="stable")
    above = up[children]
    while len(found[-1]):
        lows, highs = np.searchsorted(above, found[-1], "left"), np.searchsorted(above, found[-1], "right")
        many = highs - lows
        places = np.repeat(lows - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        found.append(children[places])
    return found[:-1]


def centroid_totals(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values (one row per kind) over each node's subtree, in a forest given by parent edges (-1: top).

    Every round splits all components at their centroids at once: a node below
    which, and above which, at most half of the component lies.
    """
    up, out = parent.copy(), np.zeros_like(values)
    gone = -2  # marks a node that has been a centroid
    while True:
        levels = _levels(up)
        if not levels or not len(levels[0]):
            return out
        component = np.full(len(up), -1)
        size = np.ones(len(up), np.int64)
        for depth, nodes in enumerate(levels):
            component[nodes] = nodes if not depth else component[up[nodes]]
        for nodes in reversed(levels[1:]):
            np.add.at(size, up[nodes], size[nodes])
        centroid = np.full(len(up), -1)
        for nodes in levels:  # the deepest node with half of its component below it
            half = nodes[2 * size[nodes] >= size[component[nodes]]]
            centroid[component[half]] = half
        tops = levels[0]
        middle = centroid[tops]
        live = np.concatenate(levels)
        whole = np.zeros_like(values)
        np.add.at(whole.T, component[live], values.T[live])
        # Without the centroids, their children are tops, and what is left above keeps its top.
        split = up.copy()
        split[np.isin(up, middle)] = -1
        split[middle] = gone
        below = np.full(len(up), -1)
        for depth, nodes in enumerate(levels):
            fresh = split[nodes] < 0
            below[nodes] = nodes if not depth else np.where(fresh, nodes, below[up[nodes]])
        rest = np.zeros_like(values)
        others = live[split[live] != gone]
        upper = others[below[others] == component[others]]
        np.add.at(rest.T, component[upper], values.T[upper])
        hung = whole[:, tops] - np.where(middle == tops, 0, rest[:, tops])
        walker = middle
        while len(walker):
            out[:, walker] += hung
            higher = up[walker]
            walker, hung = higher[higher >= 0], hung[:, higher >= 0]
        up = split


_KEYS = ["g", "h"]
_SOLVED = "conv_id long, depth long, leaves long, saved long, top_conv long, top_depth long"


def _solve(table: pa.Table) -> pa.RecordBatch:
    conv, depth, above = (table.column(name).to_numpy() for name in ("conv_id", "depth", "parent_conv_id"))
    names, code = np.unique(np.concatenate((conv, above)), return_inverse=True)
    key, wanted = depth * len(names) + code[: len(conv)], (depth - 1) * len(names) + code[len(conv) :]
    order = np.argsort(key)
    found = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
    parent = np.where(key[order][found] == wanted, order[found], -1)
    for name in _KEYS:  # the node above may be of another part
        part = table.column(name).to_numpy()
        parent[part[parent] != part] = -1
    values = np.stack([table.column(name).to_numpy() for name in ("leaves", "saved")])
    totals = centroid_totals(parent, values)
    top = np.arange(len(conv))
    while not np.array_equal(higher := np.where(parent[top] < 0, top, top[np.maximum(parent[top], 0)]), top):
        top = higher
    arrays = [conv, depth, *totals, conv[top], depth[top]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], schema=_ARROW)


_ARROW = pa.schema([(name, pa.int64()) for name in ("conv_id", "depth", "leaves", "saved", "top_conv", "top_depth")])


def _solved(nodes: DataFrame) -> DataFrame:
    """Totals within each part; a part (columns g and h) is whole in a task, with others up to some `PIECE` nodes at a time."""
    most = PIECE

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(name).to_numpy() for name in _KEYS])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if last is not None and not np.array_equal(keys[:, 0], last):
                cuts = np.concatenate(([0], cuts))
            begin = 0
            for cut in cuts.tolist():
                if rows + cut - begin >= most:
                    yield _solve(pa.Table.from_batches([*held, batch.slice(begin, cut - begin)]))
                    held, rows, begin = [], 0, cut
            held.append(batch.slice(begin))
            rows, last = rows + batch.num_rows - begin, keys[:, -1]
        if rows:
            yield _solve(pa.Table.from_batches(held))

    wanted = nodes.select(*_KEYS, "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(0)).alias("parent_conv_id"), "leaves", "saved")
    return wanted.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "depth").mapInArrow(solve, _SOLVED)


def _attached(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes with the totals of the tops that hang on them added to their own values."""
    sums = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    sums = sums.agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    joined = nodes.join(sums, ["conv_id", "depth"], "left")
    more = {name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) for name in ("leaves", "saved")}
    return joined.withColumns(more).drop("_leaves", "_saved")


def _banded(nodes: DataFrame) -> DataFrame:
    """Totals over each node's subtree, for conv_id, depth, parent_conv_id, leaves and saved of a tree.

    A tree of more than `BAND` nodes is cut into bands of depth. The tops of the
    parts of a band form a tree of their own, of which the same is asked.
    """
    found = nodes.groupBy("depth").count().agg(F.sum("count"), F.max("count")).first()
    if found[0] is None or found[0] <= BAND:
        return _solved(nodes.withColumns({"g": F.lit(0).cast("long"), "h": F.lit(0).cast("long")}))
    width = max(2, BAND // found[1])
    band = F.floor(F.col("depth") / width).cast("long")
    nodes = nodes.withColumns({"g": band, "h": F.lit(0).cast("long")})
    first = checkpointed(_solved(nodes))
    edges = nodes.select("conv_id", "depth", "parent_conv_id")
    is_top = (F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
    tops = first.filter(is_top).join(edges, ["conv_id", "depth"])
    owner = first.select(
        F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("top_conv").alias("owner")
    )
    tops = checkpointed(tops.join(owner, ["parent_conv_id", "depth"], "left"))
    smaller = tops.select("conv_id", band.alias("depth"), F.col("owner").alias("parent_conv_id"), "leaves", "saved")
    totals = _banded(smaller).select("conv_id", F.col("depth").alias("g"), "leaves", "saved")
    hanging = tops.select("conv_id", band.alias("g"), "parent_conv_id", "depth").join(totals, ["conv_id", "g"])
    return _solved(_attached(nodes, hanging.filter(F.col("parent_conv_id").isNotNull())))


def _rolled_up(tree: DataFrame, rows: DataFrame, hot: DataFrame) -> DataFrame:
    """conv_id, depth, leaves and saved over the subtree of each node of the tree."""
    is_light = F.col("weight") <= PIECE
    is_top = is_light & (F.coalesce("parent_weight", F.lit(PIECE + 1)) > PIECE)
    tops = tree.filter(is_top).select("a", "b", F.col("depth").alias("h"), F.col("conv_id").alias("g"))
    root = tree.filter(is_top & (F.col("depth") == 0)).first()
    if root:  # the whole trie is one piece
        light = tree.withColumns({"g": F.lit(root.conv_id), "h": F.lit(0).cast("long")})
    else:
        # Each conversation passes one top at most. The light nodes that it names lie at and below that top.
        piece = _looked_up(rows.select("conv_id", "a", "b"), tops, ["a", "b"], hot).select("conv_id", "g", "h")
        light = tree.filter(is_light).join(piece, "conv_id")
    light = checkpointed(_solved(light))
    hanging = tree.filter(is_top & F.col("parent_conv_id").isNotNull()).select("conv_id", "depth", "parent_conv_id")
    hanging = light.select("conv_id", "depth", "leaves", "saved").join(hanging, ["conv_id", "depth"])
    heavy = tree.filter(~is_light).select("conv_id", "depth", "parent_conv_id", "leaves", "saved")
    above = _banded(checkpointed(_attached(heavy, hanging)))
    columns = ["conv_id", "depth", "leaves", "saved"]
    return light.select(*columns).unionByName(above.select(*columns))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, hashlib.sha256()
    names = ["a", "b", "ends_sha256"]
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(name).to_pylist() for name in ("a", "b", "ids")), strict=True):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*done, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=names)


def _ends(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Digest of the conversations that end at a node: their ids in blocks, the blocks read in order."""
    ends = rows.filter(F.col("depth") == F.col("length")).select("a", "b", "conv_id")
    ends = ends.unionByName(lengths.filter("length = 0").select(*_root(), "conv_id"))
    blocks = ends.groupBy("a", "b", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    ordered = blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block")
    return ordered.mapInArrow(_digests, "a long, b long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations."""
    hashed = turns.withColumns({name: F.xxhash64(F.lit(seed), "depth", "content") for seed, name in ((1, "x"), (2, "y"))})
    rows = checkpointed(
        _running(hashed, ["depth"], {"a": "x", "b": "y"}).select(
            "conv_id", "depth", "chars", "length", "a", "b",
            F.col("a").bitwiseXOR(F.col("x")).alias("above_a"), F.col("b").bitwiseXOR(F.col("y")).alias("above_b"),
        )
    )
    weight = F.sum(F.col("length") - F.col("depth") + 1).alias("weight")
    nodes = rows.groupBy("a", "b", "above_a", "above_b", "depth", "chars").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), weight
    )
    root = lengths.agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), (F.sum("length") + 1).alias("weight")
    ).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(
        *_root(), none.alias("above_a"), none.alias("above_b"),
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id", "weight",
    )
    nodes = nodes.unionByName(root)
    children = nodes.filter("depth > 0").groupBy(F.col("above_a").alias("a"), F.col("above_b").alias("b"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpointed(nodes.join(children, ["a", "b"], "left").na.fill(0, ["n_children"]))
    many, members = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_convs"), F.lit(0))).first()
    parents = nodes.select(
        F.col("a").alias("above_a"), F.col("b").alias("above_b"),
        F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("parent_weight"), "n_children",
    )
    wide = parents.filter(_is_hot("n_children", many))
    below = _looked_up(nodes.filter("depth > 0"), parents.drop("n_children"), ["above_a", "above_b"], wide)
    top = nodes.filter("depth = 0").withColumns({"parent_conv_id": none, "parent_weight": none})
    tree = below.unionByName(top).withColumns(
        {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}
    )
    tree = checkpointed(tree)
    totals = _rolled_up(tree, rows, nodes.filter(_is_hot("n_convs", members)))
    return (
        tree.drop("leaves", "saved")
        .join(totals, ["conv_id", "depth"])
        .join(_ends(rows, lengths), ["a", "b"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie over conversations that share the opening turns of their group."""
    return trie(*rebuilt(conversations))
