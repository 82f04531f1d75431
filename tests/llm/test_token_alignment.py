"""Alignment of two vocabularies against a plain walk over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hackney.llm import token_alignment
from hackney.llm.queries import COUNT_VOCABULARY, PIECE_VOCABULARY, vocabulary

ODD = [
    None, "", " ", "  ", "a", " a b  c   d\n e \n\nf\t g", "x ▁ y", "▁", "<|endoftext|> and <s> </s> <0x0A> <unk>", "é日本語 テキスト ελληνικά Ünï ß",
    "😀 👍🏽 á ​ \xa0 b", "don't we'll  I'm 12345 1 2", "a" * 3000, "ab " * 500, "\r\n a\x00b \x1f c", "İstanbul ΣΑΣ ﬁ", " \n" * 40,
]


def walked(rows):
    a, b = token_alignment.ByteLevel(vocabulary(COUNT_VOCABULARY)), token_alignment.Pieces(vocabulary(PIECE_VOCABULARY))
    found, counts = [], Counter()
    for doc_id, text in rows:
        parts = []
        if text:
            ids = a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
            whole = (" " + text).encode()
            if all(b"".join(kind.pieces[i] for i in part) == whole for kind, part in zip((a, b), ids, strict=True)):
                parts = [[], []]
                for kind, part, out in zip((a, b), ids, parts, strict=True):
                    end = 0
                    for i in part:
                        end += len(kind.pieces[i])
                        out.append((end, i))
        groups, links, cut = [], [], [[], []]
        ends = sorted(set(dict(parts[0])) & set(dict(parts[1]))) if parts else []
        low = 0
        for end in ends:
            cut = [[i for at, i in part if low < at <= end] for part in parts]
            groups.append("|".join(",".join(map(str, side)) for side in cut))
            low = end
        if parts:
            links = [(i, j) for at, i in parts[0] for to, j in parts[1] if at == to] if len(parts[0]) < 2000 else [
                (dict(parts[0])[end], dict(parts[1])[end]) for end in ends
            ]
        counts.update(links)
        found.append((doc_id, len(parts[0]) if parts else 0, len(parts[1]) if parts else 0, groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = Counter()
    for doc_id, n_a, n_b, groups, links in found:
        n_best, total = sum(counts[link] == best[link[1]] for link in links), sum(counts[link] for link in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out[(doc_id, n_a, n_b, len(groups), len(links), n_best, total, digest)] += 1
    return out


def given():
    rng = random.Random(11)
    letters = "aaeeiioun tr s-1é. ,’日\n Ω"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    return [*enumerate(texts), (None, "a b c"), (3, "a b c"), (3, "a b c")]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent, kept", [(1 << 17, 1 << 22), (4, 10)])
def test_alignment(spark, monkeypatch, frequent, kept):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    rows = given()
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, pair string, row int").repartition(3)
    found = token_alignment.alignment(docs, vocabulary(COUNT_VOCABULARY), vocabulary(PIECE_VOCABULARY))
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == walked(rows)
    assert token_alignment.alignment(docs.limit(0), vocabulary(COUNT_VOCABULARY), vocabulary(PIECE_VOCABULARY)).collect() == []


def test_chunks_are_forgotten(monkeypatch):
    import pyarrow as pa

    texts = [text for _, text in given() if text]
    once = token_alignment._Chunks(vocabulary(COUNT_VOCABULARY), vocabulary(PIECE_VOCABULARY))
    whole = token_alignment._align(once, pa.record_batch([pa.array(texts)], names=["text"]))
    monkeypatch.setattr(token_alignment, "KEPT", 10)
    for place, text in enumerate(texts):
        alone = token_alignment._align(once, pa.record_batch([pa.array([text])], names=["text"]))
        assert [column[0].as_py() for column in alone] == [column[place].as_py() for column in whole]


def test_a_long_text():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(500_000))  # over 2 MB
    a, b = token_alignment.ByteLevel(vocabulary(COUNT_VOCABULARY)), token_alignment.Pieces(vocabulary(PIECE_VOCABULARY))
    import pyarrow as pa

    known = token_alignment._Chunks(vocabulary(COUNT_VOCABULARY), vocabulary(PIECE_VOCABULARY))
    found = token_alignment._align(known, pa.record_batch([pa.array([text])], names=["text"]))
    alone = token_alignment.Aligned([text], a, b)
    assert found[0][0].as_py() == alone.n_a[0] and found[1][0].as_py() == alone.n_b[0]
    assert found[2][0].as_py() == alone.n_groups[0] and found[3][0].as_py() == alone.n_links[0]
    assert found[4][0].as_py() == hashlib.sha256(alone.written[0].encode()).hexdigest()
    pairs, times = np.unique(alone.pairs, return_counts=True)
    assert found[5][0].as_py() == pairs.tolist() and found[6][0].as_py() == times.tolist()


def test_groups_of_overlapping_intervals():
    order, group = token_alignment.coalesced(np.array([0, 2, 4, 0, 3, 4]), np.array([2, 4, 6, 3, 4, 6]))
    assert group.tolist() == [0, 0, 0, 0, 1, 1]
    first, second = token_alignment.overlaps(np.array([0, 2, 4]), np.array([2, 4, 6]), np.array([0, 3, 4]), np.array([3, 4, 6]))
    assert list(zip(first.tolist(), second.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2)]
