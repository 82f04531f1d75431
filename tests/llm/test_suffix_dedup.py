"""Repeated byte strings: passages that very many texts share, cuts at the edges of blocks, and all bounds made small."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hackney.llm import suffix_dedup
from hackney.llm.common import keyed_texts

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(rng, many):
    return "".join(rng.choices(LETTERS, k=many))


def shared_passages(rng, many):
    """Texts of their own letters around one passage, whole or in part, and some of short period or there twice."""
    passage = letters(rng, 500)
    texts = [(i, f"{letters(rng, 130)}{passage}{letters(rng, 130)}") for i in range(many)]
    texts += [(many + i, letters(rng, 50) + passage[i : 300 + 2 * i] + letters(rng, 50)) for i in range(20)]
    texts += [(500 + i, letters(rng, i) + "abc" * 60 + "z" * (90 + i)) for i in range(20)]
    texts += [texts[3], texts[3], (4, texts[3][1]), (None, passage), (None, None), (7, "")]
    rng.shuffle(texts)
    return texts


def brute_force(rows, width):
    """Per doc_id and tie, the removed bytes."""
    seen, out = {}, {}
    for row in sorted(rows, key=lambda row: (row.doc_id is not None, row.doc_id or 0, row.tie)):
        text = row.text.encode()
        gone = [False] * len(text)
        for i in range(len(text) - width + 1):
            place = (row.doc_id, row.tie, i)
            if seen.setdefault(text[i : i + width], place) != place:
                gone[i : i + width] = [True] * width
        out[(row.doc_id, row.text)] = bytes(b for b, g in zip(text, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize(("frequent", "tasks"), [(1, 1), (8, 1), (8, 3), (64, 1), (4096, 3)])
def test_bounds_change_no_result(spark, monkeypatch, frequent, tasks):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "MOST_KNOWN", 1 << 31 if frequent > 1 else 64)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 20000)
    docs = spark.createDataFrame(shared_passages(random.Random(3), 300), "doc_id long, text string").repartition(tasks)
    docs = docs.localCheckpoint()
    wanted = brute_force(keyed_texts(docs).collect(), 100)
    found = suffix_dedup.kept_bytes(docs).collect()
    assert len(found) == docs.count()
    texts = {(row.doc_id, row.n_bytes, bytes(row.kept)) for row in found}
    assert texts == {(doc_id, len(text.encode()), kept) for (doc_id, text), kept in wanted.items()}


@pytest.mark.parametrize(("frequent", "width"), [(1, 1), (8, 9), (128, 38)])
def test_classes_follow_the_number_of_contexts(spark, monkeypatch, frequent, width):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)

    class All:
        def maybe(self, hashes):
            return np.ones(len(hashes), bool)

    docs = spark.createDataFrame(shared_passages(random.Random(3), 300), "doc_id long, text string")
    listed, widths = suffix_dedup._frequent(docs.select("text").na.drop().coalesce(1), All(), 100)
    assert len(listed) and width in widths and (listed[1:] > listed[:-1]).all()


def test_passage_of_many_texts_sends_little(spark, monkeypatch):
    """Its stretches were sent string by string, whatever text goes on around it: 14 times the texts' bytes."""
    rng = random.Random(4)
    passage = letters(rng, 500)
    docs = [(i, f"{letters(rng, 130)}{passage}{letters(rng, 130)}") for i in range(300)]

    def size(table):
        lengths = [np.frombuffer(value.as_py(), np.uint32).sum() for value in table.column("lengths") if value.is_valid]
        sent = pa.array([int(sum(lengths)).to_bytes(8, "little")], pa.binary())
        return pa.table([pa.array([0], pa.int32()), *[sent] * 4], names=["group", "keys", "ties", "counts", "marks"])

    monkeypatch.setattr(suffix_dedup, "FREQUENT", 16)
    monkeypatch.setattr(suffix_dedup, "_settle", lambda length, buckets: size)
    shards = suffix_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)).collect()
    sent = sum(int.from_bytes(row["keys"], "little") for row in shards)
    assert 0 < sent < 3 * sum(len(text) for _, text in docs)


def test_one_place_cut_in_two_ways(spark):
    """A row that is there twice, with other blocks, does not repeat itself where one of the blocks ends."""
    rng = random.Random(6)
    long, before, between = letters(rng, 1_500_000), letters(rng, 1000), letters(rng, 700_000)
    docs = [(1, before), (5, long), (2, between), (5, long)]
    found = suffix_dedup.kept_bytes(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((row.doc_id, row.n_removed) for row in found) == [(1, 0), (2, 0), (5, 0), (5, 0)]
