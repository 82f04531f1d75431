"""Counts against brute force, the Kneser-Ney model against its formulas, bands against planted outliers."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hackney.llm import kneser_ney, quality_rules
from hackney.llm.queries import queries


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, given, docs):
    wanted = Counter()
    for doc_id, text, _ in docs:
        found = counts(text)
        wanted[(doc_id, *found, found[0] < 50 or 100 * found[4] > 50 * found[0])] += 1
    result = queries()["op13_quality_rules"](spark, given)
    assert result.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = result.collect()
    assert Counter(tuple(row)[:7] for row in rows) == wanted
    assert not any(row.base_failed and row.kept for row in rows)
    assert any(row.kept for row in rows)


def test_empty(spark, empty):
    assert queries()["op13_quality_rules"](spark, empty).collect() == []


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a", "a b a b a b a", "x " * 3, "a\n\n a\na\n", "#*$ %&|<> <>", "one two three four"])
def test_counts_of_small_texts(text, monkeypatch):
    assert quality_rules.counts_of(text) == counts(text)
    monkeypatch.setattr(quality_rules, "LONG", 0)
    assert quality_rules.counts_of(text) == counts(text)


def symbols(text):
    return [int(kneser_ney._symbol_table()[ord(c)]) for c in " " * (kneser_ney.ORDER - 1) + text.lower()]


def formulas(texts):
    """Probability of a symbol after its context, straight from the definition, with sets and dictionaries."""
    order = kneser_ney.ORDER
    seen = [None] + [defaultdict(int) for _ in range(order)]
    for text in texts:
        row = symbols(text)
        for i in range(order - 1, len(row)):
            seen[order][tuple(row[i - order + 1 : i + 1])] += 1
    for length in range(order - 1, 0, -1):
        for run in seen[length + 1]:
            seen[length][run[1:]] += 1

    def off(length, count):
        return kneser_ney.discounts(np.array(list(seen[length].values())))[min(count, 3) - 1]

    def probability(run):
        if not run:
            return 1 / kneser_ney.SYMBOLS
        same = {other: n for other, n in seen[len(run)].items() if other[:-1] == run[:-1]}
        if not same:
            return probability(run[1:])
        whole, count = sum(same.values()), same.get(run, 0)
        left = sum(off(len(run), n) for n in same.values()) / whole
        return (count - off(len(run), count) if count else 0) / whole + left * probability(run[1:])

    return probability


def model_of(texts):
    tally = kneser_ney.Tally(most=50)
    for codes, _ in kneser_ney.hashes(texts):
        tally.add(codes)
    return kneser_ney.build(*tally.merged())


def test_model_follows_the_formulas():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab c,é1") for _ in range(60)) for _ in range(12)] + [""]
    model, probability = model_of(texts), formulas(texts)
    for text in ["abc aab", "zq é日", texts[0], "1"]:
        (found,) = [model.log_probabilities(codes) for codes, _ in kneser_ney.hashes([text])]
        row = symbols(text)
        wanted = [math.log(probability(tuple(row[i - 3 : i + 1]))) for i in range(3, len(row))]
        assert np.allclose(found, wanted, rtol=1e-9)


def test_probabilities_add_up_to_one():
    model = model_of(["the quick brown fox " * 3, "jumps over"])
    for context in (0, 5 << 12 | 3 << 6 | 1, 20 << 12 | 8 << 6 | 5):
        codes = (np.int32(context) << kneser_ney.BITS | np.arange(kneser_ney.SYMBOLS)).astype(np.int32)
        assert math.isclose(np.exp(model.log_probabilities(codes)).sum(), 1, rel_tol=1e-9)


def test_long_texts_are_cut_without_a_difference(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (500, 0, 1, 37)]

    def found():
        parts = list(kneser_ney.hashes(texts))
        codes, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
        return [codes[owners == i].tolist() for i in range(len(texts))]

    whole = found()
    assert list(map(len, whole)) == [500, 0, 1, 37]
    monkeypatch.setattr(kneser_ney, "BLOCK", 10)
    assert found() == whole


def test_bands_reject_what_is_unlike_the_language(spark):
    rng = random.Random(8)
    syllables = {"a": ["ba", "lo", "mi", "ter", "sun"], "b": ["zwix", "kray", "pfu", "ghe", "tsch"]}

    def text(lang):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(200))

    rows = [(i, text(lang), lang) for i, lang in enumerate("ab" * 150)]
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz0123456789#;_") for _ in range(6)) for _ in range(200))
    rows += [(1000, junk, "a"), (1001, junk[::-1], None), (1002, text("a"), None), (1003, text("b"), "rare")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {row.doc_id: row for row in quality_rules.quality_rules(frame).collect()}
    assert sorted(i for i, row in found.items() if not row.kept) == [1000, 1001]
    assert found[0].lower != found[1].lower and found[1002].upper == found[1001].upper


def test_every_character_is_a_symbol_of_its_own():
    """The characters beyond ASCII once shared 24 symbols, so that a text had the perplexity of quite another one."""
    points = [*range(0x21, 0x31), *range(0x3A, 0xD800), *range(0xE000, 0x110000, 7)]
    letters = dict.fromkeys(c for c in map(chr, points) if c.lower() == c and not c.isspace() and not 0x2000 <= ord(c) <= 0x200A)
    (found,) = [codes for codes, _ in kneser_ney.hashes(["".join(c for c in letters if ord(c) < 0x10000)])]
    assert len(np.unique(found & np.uint64(kneser_ney.mask(1)))) == len(found)
    beyond = [c for c in letters if ord(c) >= 0x10000]
    codes, owner = (np.concatenate(x) for x in zip(*kneser_ney.hashes(beyond), strict=True))
    assert np.bincount(owner).tolist() == [2] * len(beyond)
    assert len(np.unique(codes)) == len(np.unique(codes[::2])) + len(beyond)


def test_text_of_other_letters_is_unlike_the_language(spark):
    rng = random.Random(9)
    greek = [chr(c) for c in range(0x3B1, 0x3CA)]
    syllables = ["".join(rng.choice(greek) for _ in range(3)) for _ in range(8)]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(150)) for _ in range(120)]
    # For each letter one that once had the same symbol.
    same = {a: chr(next(b for b in range(0x4E00, 0x9FFF) if b * 2654435761 // 65536 % 24 == ord(a) * 2654435761 // 65536 % 24)) for a in greek}
    rows = [*enumerate(texts), (1000, "".join(same.get(c, c) for c in texts[0]))]
    frame = spark.createDataFrame([(i, text, "el") for i, text in rows], "doc_id long, text string, lang string")
    assert [row.doc_id for row in quality_rules.quality_rules(frame).collect() if not row.kept] == [1000]


@pytest.mark.parametrize("most", [0, 40, 200])
def test_models_in_tables_are_those_in_arrays(spark, monkeypatch, most):
    """All runs count, those seen and broadcast, those seen and joined, and those of texts the model has not seen."""
    rng = random.Random(most)
    learned = ["".join(rng.choice("aaab c,é日本😀") for _ in range(rng.randrange(90))) for _ in range(40)] + [None, ""]
    others = [*learned, "zq é日 unseen 한국어 😂", "日本" * 40, "aab c" * 9, "q", None]
    frames = [
        spark.createDataFrame([(i % 30, text, None) for i, text in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
        for texts in (learned, others)
    ]

    def found(block):
        monkeypatch.setattr(kneser_ney, "BLOCK", block)
        model = quality_rules.train(frames[0])
        rows = quality_rules.measures(frames[1], model).collect()
        return model, sorted((row[:7], row.log_perplexity) for row in rows if row.n_words or row.log_perplexity is not None)

    arrays, wanted = found(1 << 20)
    monkeypatch.setattr(quality_rules, "BROADCAST_RUNS", most)
    monkeypatch.setattr(quality_rules, "COUNTED_RUNS", 50)
    tables, rows = found(16)
    assert isinstance(arrays, kneser_ney.Model) and not isinstance(tables, kneser_ney.Model)
    assert len(tables.frequent.runs) <= most and (most == 0 or len(tables.frequent.runs) > 0)
    assert [row[0][0] for row in rows] == [row[0][0] for row in wanted]
    assert np.allclose([row[1] for row in rows], [row[1] for row in wanted], rtol=1e-9)
