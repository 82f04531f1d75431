"""Token counts of whole texts under a byte-level BPE vocabulary, without a shuffle of pre-tokens.

A text's count is the sum of the counts of its pre-tokens. Two tiers answer for
a pre-token: a table of the most frequent ones of the whole corpus with their
counts, broadcast to all workers, and behind it a cache in each worker, filled
from the vocabulary as pre-tokens are missed. Neither changes a result. What has
characters on which a rule for pre-tokens may differ from the library's is split by
the library's own, piece by piece, and looked up all the same.

The frequent ones are found in one pass: every task keeps a bounded table of
word counts (all lowered when it is full, so that a word that makes up more
than 1/`TASK_WORDS` of the task's words stays), and sends its largest.

The text of a special token inside a text is that token, as the library's
default has it. Null and empty texts have no tokens; rows that share a doc_id
are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import texts

#: Pre-tokens in the broadcast table, and words that a task counts and sends at most.
FREQUENT = 1 << 15
TASK_WORDS = 1 << 18
TASK_SENDS = 1 << 13
#: Entries in a worker's cache before it is emptied, and characters of the longest entry.
CACHE = 1 << 18
LONGEST = 64

# The split of this kind of vocabulary into pre-tokens.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A split before a single space and a character that is no white space never cuts a pre-token, whatever stands before.
_PIECE = re.compile(r" (?=[!-~¡-ɏ])")
#: Where the split above and the library's own surely agree.
_KNOWN = re.compile(r"[\t\n\r -~¡-ɏ]*")


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


def _token_count(tokenizer, text: str) -> int:
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def pre_tokens(tokenizer, text: str) -> list[str]:
    """The pre-tokens of a text; a text of other scripts or signs is split by the library."""
    if _KNOWN.fullmatch(text):
        return _PRE_TOKEN.findall(text)
    return [text[start:end] for _, (start, end) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class _Bounded(dict):
    def put(self, key, value):
        if len(key) > LONGEST:
            return value
        if len(self) >= CACHE:
            self.clear()
        self[key] = value
        return value


class _PreTokens(_Bounded):
    """Count of a pre-token: from the frequent ones, the cache or the vocabulary."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__()
        self.tokenizer, self.frequent = tokenizer, frequent

    def __missing__(self, token: str) -> int:
        known = self.frequent.get(token)
        return known if known is not None else self.put(token, _token_count(self.tokenizer, token))


class _Pieces(_Bounded):
    """Count of a piece between single spaces, of its pre-tokens."""

    def __init__(self, lengths: _PreTokens):
        super().__init__()
        self.lengths = lengths

    def __missing__(self, piece: str) -> int:
        lengths = self.lengths
        return self.put(piece, sum(lengths[token] for token in pre_tokens(lengths.tokenizer, " " + piece)))


class Counts:
    """Counts tokens of texts with the two tiers."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer = load(path)
        names = specials(self.tokenizer)
        self.special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None
        self.lengths = _PreTokens(self.tokenizer, frequent)
        self.pieces = _Pieces(self.lengths)

    def _plain(self, text: str) -> int:
        first, *rest = _PIECE.split(text)
        lengths = self.lengths
        return sum(lengths[token] for token in pre_tokens(self.tokenizer, first)) + sum(map(self.pieces.__getitem__, rest))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(_PIECE.split(text.as_py())[1:])
            if len(counts) > TASK_WORDS:
                # Lower all by what the smaller half has at most; at least half of the entries go.
                least = sorted(counts.values())[len(counts) // 2]
                counts = Counter({word: n - least for word, n in counts.items() if n > least})
    most = counts.most_common(TASK_SENDS)
    yield pa.RecordBatch.from_arrays(
        [pa.array([word for word, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], names=["word", "n"]
    )


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The most frequent pre-tokens of the corpus with their token counts; `FREQUENT` at most."""
    words = texts(docs).select("text").mapInArrow(_frequent_words, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    tokenizer = load(path)
    tokens = list(dict.fromkeys(token for row in top for token in pre_tokens(tokenizer, " " + row["word"])))[:FREQUENT]
    encoded = tokenizer.encode_batch(tokens, add_special_tokens=False) if tokens else []
    return {token: len(encoding.ids) for token, encoding in zip(tokens, encoded, strict=True)}


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether a text is over the limit, for every row."""
    rows = texts(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, table.value)
        for batch in batches:
            tokens = [counts.count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
