"""The trie of conversations against brute force, whole and cut into pieces and bands."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hackney.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, a string, depth string, h string"


def conversations():
    """Shared openings, a long one, copies, nulls, a repeated row, ids without an opening one, negative ids, no turns left."""
    rng = random.Random(3)
    rows = []
    for conv in [*range(95, 130), *range(200, 240), 301, 302, 455, -150, -149, -100, 7000]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["", None, "ja", "nein", "é日本" * turn])))
    rows += [(500, turn, "user", f"t{turn % 3}") for turn in range(260)]
    rows += [(conv, turn, "user", f"t{turn % 3}") for conv in range(501, 504) for turn in range(250)]
    rows += [(600 + conv, turn, "user", "copy") for conv in range(40) for turn in range(3)]
    rows += [(200, None, "user", "first"), (200, None, None, None), (None, 1, "user", "lost"), (201, 0, "user", "again"), (201, 0, "user", "again")]
    rng.shuffle(rows)
    return rows


def content(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def remainder(value, by):
    return value - abs(value) % by * (1 if value >= 0 else -1)


def brute_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, content(role or "", text or ""), role or "", text or ""))
    own = {conv: [turn[3:] for turn in sorted(found)] for conv, found in turns.items()}
    built = {}
    for conv, found in own.items():
        opening = zlib.crc32(str(conv).encode()) % 6
        built[conv] = tuple(own.get(remainder(conv, 100), [])[:opening] + found[opening:])
    members = defaultdict(list)
    for conv, path in built.items():
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
    children, leaves, saved = Counter(node[:-1] for node in members if node), Counter(), Counter()
    for node, of in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    out = Counter()
    for node, of in members.items():
        ends = ",".join(str(conv) for conv in sorted(of) if len(built[conv]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[(min(of), len(node), parent, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("piece, band, block, hot", [(1 << 16, 1 << 20, 16, 1000), (40, 100, 2, 10)])
def test_trie(spark, monkeypatch, piece, band, block, hot):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", block)
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    rows = conversations()
    frame = spark.createDataFrame([(*row, "a", "d", "h") for row in rows], SCHEMA).repartition(5)
    found = prefix_trie.prefix_trie(frame)
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == brute_force(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(frame).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "")], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_centroid_totals(seed):
    rng = np.random.default_rng(seed)
    many = [1, 2, 300, 300, 2000][seed]
    reach = [1, 1, 300, 2, 40][seed]
    parent = np.array([i - 1 - rng.integers(min(i, reach)) if i and rng.random() > 0.01 else -1 for i in range(many)])
    shuffled = rng.permutation(many)  # parents need not come first
    moved = np.full(many, -1)
    moved[shuffled] = np.where(parent < 0, -1, shuffled[parent])
    values = rng.integers(0, 1 << 40, (2, many))
    wanted = np.zeros((2, many), np.int64)
    wanted[:, shuffled] = values
    given = wanted.copy()
    for i in range(many - 1, 0, -1):
        if parent[i] >= 0:
            wanted[:, shuffled[parent[i]]] += wanted[:, shuffled[i]]
    assert np.array_equal(prefix_trie.centroid_totals(moved, given), wanted)
