"""Words that are regular on purpose are still told apart, in the hashes and in the operators that use them."""

from collections import Counter

import numpy as np
import pytest

from hackney.llm import near_dedup, substring_dedup
from hackney.llm.words import Words


def doubled(steps, letters="ab"):
    """A word that repeats itself with its letters swapped, and the same word with all letters swapped."""
    word = letters[0]
    swap = str.maketrans(letters, letters[::-1])
    for _ in range(steps):
        word += word.translate(swap)
    return word, word.translate(swap)


def hashes(text, which=0):
    raw = text.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes(which)


@pytest.mark.parametrize("which", [0, 1])
def test_every_word_has_its_own_hash(which):
    words = [word for steps in range(13) for word in doubled(steps)]
    words += ["a" * n for n in range(3, 600)] + [f"{'x' * 250}{i}" for i in range(300)] + ["é", "日本", "\x00", "\x00\x00", "a\x00"]
    words += [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"] + ["abcdefgh", "abcdefghi", "abcdefg"]
    words = list(dict.fromkeys(words))
    found = hashes(" ".join(words + words), which)
    assert len(found) == 2 * len(words) and (found[: len(words)] == found[len(words) :]).all()
    assert len(set(found.tolist())) == len(words)
    assert (found != hashes(" ".join(words + words), 1 - which)).all()


def test_no_words():
    assert len(hashes("")) == 0 and len(hashes(" \n")) == 0


@pytest.mark.parametrize("steps", [8, 10, 12])
def test_regular_words_are_no_copies(spark, steps):
    one, other = doubled(steps)
    texts = [" ".join([one] * 20), " ".join([other] * 20), one, other, " ".join([one, other] * 10), " ".join([one] * 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    removed = {row.doc_id: row.n_removed for row in substring_dedup.kept_words(docs, digest=True).collect()}
    assert removed == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    groups = Counter(row.component_id for row in near_dedup.near_duplicates(docs).collect())
    assert groups == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}
