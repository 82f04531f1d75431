"""Encoding and decoding with a BPE vocabulary whose words carry an end mark.

A word starts as its bytes, the last one with the end mark. A segment tree over
the adjacent pairs holds each pair's merge rank together with its place, so the
root is the leftmost pair of lowest rank. A merge changes the pair to its left
and the one to its right and takes one pair out: three point updates, each
logarithmic in the word's length. It ends when the root holds no rank.

Words of like length are encoded together, one row of a matrix each, so that a
step merges once in every word that still has a mergeable pair; long words are
encoded alone on a tree of their own. A worker keeps the words it has met.

The text of a special token inside a text is that token. Decoding gives the
tokens' names joined by one space, as the library does for a vocabulary without
a decoder. Null and empty texts have no tokens; rows that share a doc_id are
encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hackney.llm.common import slices, texts

#: Symbols of the longest word that is encoded in a matrix, words in it at most, and words a worker keeps.
MATRIX_SYMBOLS = 64
MATRIX_WORDS = 1 << 15
CACHE = 1 << 18

# How this vocabulary splits a text into words, and its end mark.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = "</w>"
#: Where Python's lower case and classes and the library's surely agree; other texts are split by the library.
_KNOWN = re.compile(r"[\t\n\r -~¡-įĲ-ɏ]*")
_NO_RANK = np.int64(1) << 62


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [byte for byte in range(256) if byte not in set(prints)]
    names = {byte: chr(byte) for byte in prints} | {byte: chr(256 + i) for i, byte in enumerate(others)}
    return [names[byte] for byte in range(256)]


def _packed(ids: np.ndarray | list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return np.asarray(ids, "<u4").tobytes()


class SegmentTree:
    """Minimum over a list with point updates in logarithmic time."""

    def __init__(self, values: list[int], none: int):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.nodes = [none] * self.size + values + [none] * (self.size - len(values))
        for node in range(self.size - 1, 0, -1):
            self.nodes[node] = min(self.nodes[2 * node], self.nodes[2 * node + 1])

    def root(self) -> int:
        return self.nodes[1]

    def update(self, place: int, value: int) -> None:
        nodes, node = self.nodes, self.size + place
        nodes[node] = value
        node >>= 1
        while node:
            least = min(nodes[2 * node], nodes[2 * node + 1])
            if nodes[node] == least:
                return
            nodes[node] = least
            node >>= 1


class Vocabulary:
    """Ids, names and ranked merges of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        ids = whole["model"]["vocab"]
        self.special = {token["content"]: token["id"] for token in whole["added_tokens"]}
        numbers = ids | self.special
        self.names = [""] * (max(numbers.values()) + 1)
        for name, number in numbers.items():
            self.names[number] = name
        letters = byte_names()
        self.inner = np.array([ids[letter] for letter in letters], np.int64)
        self.last = np.array([ids[letter + _END] for letter in letters], np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(whole["model"]["merges"]):
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.stride = len(self.names)
        keys = np.array([left * self.stride + right for left, right in self.merges], np.int64)
        order = np.argsort(keys)
        found = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)
        self.keys, self.ranks, self.made = keys[order], found[order, 0], found[order, 1]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; no rank where it does not merge or a side is missing."""
        keys = left * self.stride + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        merges = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(merges, self.ranks[at], _NO_RANK), self.made[at]

    def symbols(self, word: bytes) -> np.ndarray:
        letters = np.frombuffer(word, np.uint8)
        symbols = self.inner[letters]
        symbols[-1] = self.last[letters[-1]]
        return symbols

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one word, on a tree of its own."""
        symbols = self.symbols(word).tolist()
        count = len(symbols)
        if count == 1:
            return symbols
        none = count * (len(self.merges) + 1)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))

        def value(place: int) -> int:
            """Of the pair that starts here: rank first, then place."""
            merge = self.merges.get((symbols[place], symbols[after[place]])) if after[place] < count else None
            return none if merge is None else merge[0] * count + place

        tree = SegmentTree([value(place) for place in range(count)], none)
        while tree.root() < none:
            place = tree.root() % count
            gone = after[place]
            symbols[place] = self.merges[symbols[place], symbols[gone]][1]
            symbols[gone] = -1
            after[place] = after[gone]
            if after[gone] < count:
                before[after[gone]] = place
            tree.update(gone, none)
            tree.update(place, value(place))
            if before[place] >= 0:
                tree.update(before[place], value(before[place]))
        return [symbol for symbol in symbols if symbol >= 0]

    def encode_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed token ids of words of at most `width` bytes, a power of two; a row of trees, one step for all."""
        rows, lengths = len(words), np.array([len(word) for word in words])
        symbols = np.full((rows, width + 1), -1, np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        at = np.arange(width)[None, :] < lengths[:, None]
        symbols[:, :width][at] = self.inner[letters]
        symbols[np.arange(rows), lengths - 1] = self.last[letters[np.cumsum(lengths) - 1]]
        before = np.tile(np.arange(-1, width, dtype=np.int64), (rows, 1))
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (rows, 1))
        after[:, width] = width
        tree = np.full((rows, 2 * width), _NO_RANK, np.int64)
        ranks, _ = self.pairs(symbols[:, :-1], symbols[:, 1:])
        tree[:, width:] = np.where(ranks < _NO_RANK, ranks * width + np.arange(width), _NO_RANK)
        node = width
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2
        live = np.flatnonzero(tree[:, 1] < _NO_RANK)
        while len(live):
            place = tree[live, 1] % width
            gone = after[live, place]
            _, merged = self.pairs(symbols[live, place], symbols[live, gone])
            symbols[live, place] = merged
            symbols[live, gone] = -1
            follows = after[live, gone]
            after[live, place] = follows
            before[live, follows] = place
            self._update(tree, live, gone, np.full(len(live), _NO_RANK), width)
            ranks, _ = self.pairs(merged, symbols[live, follows])
            self._update(tree, live, place, np.where(ranks < _NO_RANK, ranks * width + place, _NO_RANK), width)
            ahead = before[live, place]
            some = ahead >= 0
            rows_, ahead = live[some], ahead[some]
            ranks, _ = self.pairs(symbols[rows_, ahead], merged[some])
            self._update(tree, rows_, ahead, np.where(ranks < _NO_RANK, ranks * width + ahead, _NO_RANK), width)
            live = live[tree[live, 1] < _NO_RANK]
        left = symbols[:, :width] >= 0
        flat, ends = _packed(symbols[:, :width][left]), (4 * np.cumsum(left.sum(1))).tolist()
        return [flat[start:end] for start, end in zip([0, *ends], ends)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray, width: int) -> None:
        node = places + width
        tree[rows, node] = values
        while width > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.packed_words(words)]

    def packed_words(self, words: list[str]) -> list[bytes]:
        """Packed token ids of each word."""
        raw = [word.encode("utf-8") for word in words]
        out = [b""] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(raw):
            width = 1 << max(1, (len(word) - 1).bit_length())
            if width > MATRIX_SYMBOLS:
                out[i] = _packed(self.encode_word(word))
            else:
                by_width.setdefault(width, []).append(i)
        for width, members in by_width.items():
            for start in range(0, len(members), MATRIX_WORDS):
                part = members[start : start + MATRIX_WORDS]
                for i, ids in zip(part, self.encode_matrix([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


class Coder:
    """Encodes and decodes texts; keeps the pieces it has met in two generations, of which the older one is given up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        # Only its rules for splitting rare scripts are used, never its merges.
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte_of = {ord(name): byte for byte, name in enumerate(byte_names())}

    def _split(self, text: str) -> list[str]:
        """Pieces whose words do not cross their ends."""
        if _KNOWN.fullmatch(text):
            return unicodedata.normalize("NFC", text).lower().split()
        words = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return ["\0" + bytes(self.byte_of[ord(c)] for c in word).decode("utf-8") for word, _ in words]

    @staticmethod
    def _words_of(piece: str) -> list[str]:
        """A piece after the mark is one word as it stands."""
        return [piece[1:]] if piece[0] == "\0" else _WORD.findall(piece)

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces. One of letters alone is a word; the others are split, and their words looked up too."""
        split = {piece: self._words_of(piece) for piece in pieces if not piece.isalpha()}
        known = self.pieces
        words = {piece for piece in pieces if piece not in split}
        # A word of letters is kept as a piece as well; another one could be split differently as a piece, so it is not.
        words.update(word for found in split.values() for word in found if not (word.isalpha() and word in known))
        order = list(words)
        coded = dict(zip(order, self.vocabulary.packed_words(order), strict=True))
        known.update((word, ids) for word, ids in coded.items() if word.isalpha())
        for piece, found in split.items():
            known[piece] = b"".join([coded[word] if word in coded else known[word] for word in found])

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = []
        for text in texts_:
            parts = self.special.split(text) if self.special else [text]
            cut.append([(part if i % 2 else self._split(part)) for i, part in enumerate(parts)])
        new = {piece for parts in cut for part in parts[::2] for piece in part}
        if len(self.pieces) + len(new) > CACHE:
            self.older, self.pieces = self.pieces, {}
        new -= self.pieces.keys()
        if self.older:
            again = new & self.older.keys()
            self.pieces.update((piece, self.older[piece]) for piece in again)
            new -= again
        self._learn(list(new))
        special = self.vocabulary.special
        return [
            b"".join(
                _packed([special[part]]) if i % 2 else b"".join(map(self.pieces.__getitem__, part))
                for i, part in enumerate(parts)
            )
            for parts in cut
        ]

    def decode(self, ids: bytes) -> str:
        """Names of the ids, joined by a space."""
        return self.vocabulary.decode(np.frombuffer(ids, "<u4"))


_coders: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    """The worker's coder of a vocabulary; kept from task to task, one vocabulary at a time."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = Coder(path)
    return _coders[path]


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit numbers) and decoded text of every row."""
    return _coded(docs, path, lambda ids, text: [ids, text], "ids binary, decoded string", [pa.binary(), pa.string()])


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text of every row."""

    def digests(ids: bytes, text: str) -> list[str]:
        return [hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()]

    return _coded(docs, path, digests, "ids_sha256 string, decoded_sha256 string", [pa.string(), pa.string()])


def _coded(docs: DataFrame, path: str, make, columns: str, kinds: list[pa.DataType]) -> DataFrame:
    rows = texts(docs)
    names = [column.split()[0] for column in columns.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch, _, _ in slices(batches):
            ids = coder.encode(batch.column("text").to_pylist())
            made = list(zip(*(make(each, coder.decode(each)) for each in ids), strict=True))
            arrays = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(each) // 4 for each in ids], pa.int64()), *arrays],
                names=["doc_id", "n_tokens", *names],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(code, f"doc_id {kind}, n_tokens long, {columns}")
