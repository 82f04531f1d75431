"""Texts of any script go through the two tiers, with the library's counts."""

import random

from hackney.llm import queries, token_counts

WORDS = ["river", "it’s", "“house”", "—", "don't", "Ελλάδα", "Москва", "日本語テキスト", "naïve", "😀👩‍💻", "x\x85y", "１２", "٣٤", "İ", "é", "e\u0301", "हिन्दी"]
GAPS = [" ", "  ", "\n", "   ", "\t ", "\r\n", "\u00a0", "\u00a0 ", "\u3000", "\u200b ", "\u180e", "\x1c ", "\x85", "\u2028 ", "\0"]


def odd_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return texts + ["“", " ’s 's", "<|endoftext|> “<|endoftext|>—", "日本語。" * 300, "  a", " "]


def test_texts_of_all_scripts_are_looked_up(monkeypatch):
    path, texts = queries.vocabulary(queries.COUNT_VOCABULARY), odd_texts()
    library = token_counts.load(path)
    wanted = [len(encoding.ids) for encoding in library.encode_batch(texts, add_special_tokens=False)]
    counts, asked = token_counts.Counts(path, {}), []
    encode = token_counts._token_count
    monkeypatch.setattr(token_counts, "_token_count", lambda tokenizer, text: asked.append(text) or encode(tokenizer, text))
    assert [counts.count(text) for text in texts] == wanted
    assert max(map(len, asked)) < 30 and len(asked) == len(set(asked)) < 500
    asked.clear()
    assert [counts.count(text) for text in texts] == wanted
    assert not asked


def test_frequent_words_of_other_scripts_are_in_the_table(spark):
    path = queries.vocabulary(queries.COUNT_VOCABULARY)
    frame = spark.createDataFrame([(i, "the it’s the—river the “house” x" + "y" * 90) for i in range(9)], "doc_id long, text string")
    table = token_counts.frequent_lengths(frame, path)
    library = token_counts.load(path)
    assert {" it", "’", "—", "river", "house"} <= set(table)
    assert table == {token: len(library.encode(token, add_special_tokens=False).ids) for token in table}
