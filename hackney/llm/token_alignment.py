"""Alignment of two tokenizers' tokens on the same bytes, by interval coalescing.

Tokens of both vocabularies are byte ranges of one text. Sorted by start, with a
running maximum of their ends, they fall apart into groups wherever a token
starts at that maximum; within a group the overlapping pairs are expanded, and
the pairs that end together are links.

A text is cut before single spaces where neither vocabulary can join the bytes on
both sides, so what lies between two cuts, a chunk, always gives the same tokens,
groups and links. Each worker aligns a chunk once and keeps it; a text is put together of its
chunks. The first pass writes every document's links, counted by pair of
ids, to the shared folder. Counts of pairs come from what is written, with one
row per pair. Pairs that make up more than one in `FREQUENT` of all links, of
which there are fewer than that, meet the documents by broadcast; the rest by a
shuffle.

Null and empty texts have no tokens, and neither has a text whose tokens of one
kind give other bytes (as after a rewriting of characters): their numbers are 0
and their digest is empty text. A text of any length is taken whole; one without
a place to cut is a single chunk. Rows that share a doc_id are counted one by
one. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm.common import checkpoint_folder, slices, texts

#: Characters of chunks after which a worker forgets all that it keeps.
KEPT = 1 << 22
#: Pairs of ids with more than one in so many links are broadcast; there are fewer of them.
FREQUENT = 1 << 17

# Before a space that stands between visible characters, the one on the right of the usual Latin ones, where both
# vocabularies start a token: none of theirs has a space after another character.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[!-~¡-ɏ])")
# How byte-level vocabularies write bytes, and the space and single bytes in piece vocabularies.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _bytes_of_letters() -> dict[str, int]:
    others = [byte for byte in range(256) if byte not in _PRINTED]
    return {chr(byte): byte for byte in _PRINTED} | {chr(256 + place): byte for place, byte in enumerate(others)}


class ByteLevel:
    """Tokens of a byte-level vocabulary of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = _bytes_of_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, place in vocabulary.items():
            known = all(letter in letters for letter in token)
            self.pieces[place] = bytes(letters[letter] for letter in token) if known else token.encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast([" " + part for part in parts], add_special_tokens=False)]


class Pieces:
    """Tokens of a sentencepiece vocabulary, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self._bytes(self.model.id_to_piece(place)) for place in range(self.model.get_piece_size())]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start, and in that order the number of the group of each: overlapping intervals share one."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(opens) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in A, place in B) of intervals that share a byte; each kind is in order and without gaps or overlaps."""
    low = np.searchsorted(b_ends, a_starts, "right")
    many = np.maximum(np.searchsorted(b_starts, a_ends, "left") - low, 0)
    first = np.repeat(np.arange(len(a_starts)), many)
    return first, np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(first))


class Aligned:
    """Tokens, groups and links of many chunks that lie one after the other."""

    def __init__(self, chunks: list[str], a: ByteLevel, b: Pieces):
        sizes = np.array([len(chunk.encode()) + 1 for chunk in chunks], np.int64)
        ends = np.cumsum(sizes)
        self.a, a_starts, a_ends, a_chunk, a_good = self._tokens(chunks, a, sizes, ends)
        self.b, b_starts, b_ends, b_chunk, b_good = self._tokens(chunks, b, sizes, ends)
        self.good = a_good & b_good
        many = len(chunks)
        a_kept, b_kept = self.good[a_chunk], self.good[b_chunk]
        self.a, a_starts, a_ends, a_chunk = (x[a_kept] for x in (self.a, a_starts, a_ends, a_chunk))
        self.b, b_starts, b_ends, b_chunk = (x[b_kept] for x in (self.b, b_starts, b_ends, b_chunk))
        self.n_a, self.n_b = np.bincount(a_chunk, minlength=many), np.bincount(b_chunk, minlength=many)

        order, group = coalesced(np.concatenate((a_starts, b_starts)), np.concatenate((a_ends, b_ends)))
        is_b = order >= len(self.a)
        chunk = np.concatenate((a_chunk, b_chunk))[order]
        self.n_groups = np.bincount(chunk[np.append(True, group[1:] != group[:-1])], minlength=many) if len(order) else self.n_a
        self.written = self._written(np.concatenate((self.a, self.b))[order], group, is_b, chunk, many)

        first, second = overlaps(a_starts, a_ends, b_starts, b_ends)
        together = a_ends[first] == b_ends[second]
        first, second = first[together], second[together]
        self.pairs = (self.a[first] << np.int64(32)) | self.b[second]
        self.n_links = np.bincount(a_chunk[first], minlength=many)

    @staticmethod
    def _tokens(chunks: list[str], kind: ByteLevel | Pieces, sizes: np.ndarray, ends: np.ndarray):
        """Ids, starts, ends and chunk of every token, and whether the tokens of a chunk give its bytes."""
        found = kind.encode(chunks)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
        pieces = list(map(kind.pieces.__getitem__, ids.tolist()))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chunk = np.repeat(np.arange(len(chunks)), counts)
        if b"".join(pieces) == (" " + " ".join(chunks)).encode() and np.array_equal(
            np.bincount(chunk, lengths, len(chunks)).astype(np.int64), sizes
        ):
            good = np.ones(len(chunks), bool)
        else:
            cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
            parts = (b"".join(pieces[low:high]) for low, high in zip(cuts, cuts[1:]))
            good = np.array([part == b" " + text.encode() for part, text in zip(parts, chunks, strict=True)], bool)
        before = np.cumsum(lengths) - lengths
        places = np.cumsum(counts) - counts
        base = np.where(counts > 0, np.append(before, 0)[np.minimum(places, len(before))], 0)
        starts = before - base[chunk] + (ends - sizes)[chunk]
        return ids, starts, starts + lengths, chunk, good

    @staticmethod
    def _written(ids: np.ndarray, group: np.ndarray, is_b: np.ndarray, chunk: np.ndarray, many: int) -> list[str]:
        """Per chunk its groups as text: ids of A, a bar, ids of B; a semicolon between groups."""
        if not len(ids):
            return [""] * many
        order = np.lexsort((is_b, group))  # stable, so starts stay in order
        ids, group, is_b, chunk = ids[order], group[order], is_b[order], chunk[order]
        after = np.full(len(ids), 0)
        after[:-1] = np.where(group[1:] != group[:-1], 2, np.where(is_b[1:] != is_b[:-1], 1, 0))
        signs = np.array([",", "|", ";"], object)[after]
        last = np.append(chunk[1:] != chunk[:-1], True)
        signs[last] = ""
        text = list(map(str.__add__, map(str, ids.tolist()), signs.tolist()))
        ends = np.searchsorted(chunk, np.arange(many), "right").tolist()
        out, low = [], 0
        for high in ends:
            out.append("".join(text[low:high]))
            low = high
        return out


class _Chunks:
    """What is known of the chunks of one worker; forgotten as a whole when it is much, between two slices of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.written: list[str] = []
        self.numbers = np.zeros((5, 0), np.int64)  # tokens of A and of B, groups, links, good or not
        self.pairs = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.letters = 0

    def learn(self, chunks: list[list[str]]) -> None:
        """Aligns what is new."""
        if self.letters > KEPT:
            self._forget()
        fresh = [chunk for chunk in dict.fromkeys(chain.from_iterable(chunks)) if chunk not in self.place]
        if not fresh:
            return
        found = Aligned(fresh, self.a, self.b)
        self.place.update(zip(fresh, range(len(self.written), len(self.written) + len(fresh)), strict=True))
        self.written += found.written
        numbers = np.stack((found.n_a, found.n_b, found.n_groups, found.n_links, found.good.astype(np.int64)))
        self.numbers = np.concatenate((self.numbers, numbers), axis=1)
        self.begins = np.concatenate((self.begins, len(self.pairs) + np.cumsum(found.n_links) - found.n_links))
        self.pairs = np.concatenate((self.pairs, found.pairs))
        self.letters += sum(map(len, fresh))


class _Worker:
    """One table of chunks per process and pair of vocabularies, kept from task to task."""

    known: dict[tuple[str, str], _Chunks] = {}

    @classmethod
    def chunks(cls, a_path: str, b_path: str) -> _Chunks:
        if (a_path, b_path) not in cls.known:
            cls.known.clear()
            cls.known[a_path, b_path] = _Chunks(a_path, b_path)
        return cls.known[a_path, b_path]


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _align(known: _Chunks, batch: pa.RecordBatch) -> list[pa.Array]:
    cut = [_CUT.split(text) if text else [] for text in batch.column("text").to_pylist()]
    known.learn(cut)
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    places = np.fromiter(map(known.place.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(cut)), counts)
    good = np.bincount(owner, 1 - known.numbers[4][places], len(cut)) == 0
    written, ends = list(map(known.written.__getitem__, places.tolist())), np.cumsum(counts).tolist()
    digests = [
        hashlib.sha256(";".join(written[low:high]).encode()).hexdigest() if low < high and fine else ""
        for low, high, fine in zip([0, *ends], ends, good.tolist())
    ]
    kept = good[owner]
    places, owner = places[kept], owner[kept]
    sums = [np.bincount(owner, known.numbers[i][places], len(cut)).astype(np.int64) for i in range(4)]
    links = known.numbers[3][places]
    within = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
    codes = known.pairs[np.repeat(known.begins[places], links) + within]
    # Links of one text with the same pair are one entry with a count.
    order = np.lexsort((codes, of := np.repeat(owner, links)))
    codes, of = codes[order], of[order]
    fresh = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])))) if len(codes) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(codes)))
    offsets = pa.array(np.searchsorted(of[fresh], np.arange(len(cut) + 1)).astype(np.int32))
    return [
        *(pa.array(x, pa.int64()) for x in sums),
        pa.array(digests, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(codes[fresh], pa.int64())),
        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
    ]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and links as pairs of ids with their times."""
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Worker.chunks(a_path, b_path)
        names = ["row", "doc_id", *(field.split()[0] for field in _FIELDS.split(", "))]
        for part, _, _ in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *_align(known, part)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(align, f"row long, doc_id {kind}, {_FIELDS}")


def _links(found: DataFrame) -> DataFrame:
    """row, pair and times of every entry of the documents' links."""
    return found.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links of the whole corpus) and best (1 if no pair of the same B id has more), for every pair of ids."""
    counts = _links(found).groupBy("pair").agg(F.sum("times").alias("n"))
    ids = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = ids.groupBy("b").agg(F.max("n").alias("most"))
    # One row per id of the vocabulary at most.
    return ids.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: tokens of A and B, groups, links, links that are the best of their B id, sum of the links' counts, digest."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    aligned(docs, a_path, b_path).write.parquet(f"{folder}/documents")
    found = spark.read.parquet(f"{folder}/documents")
    pair_counts(found).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_frequent = F.col("n") * FREQUENT > total
    known = _links(found).join(F.broadcast(pairs.filter(is_frequent)), "pair", "left")

    def sums(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(
            F.coalesce(F.sum(F.col("times") * F.col("best")), F.lit(0)).alias("n_best"),
            F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("count_sum"),
        )

    rare = known.filter(F.col("n").isNull()).select("row", "pair", "times").join(pairs.filter(~is_frequent), "pair")
    parts = sums(known).unionByName(sums(rare)).groupBy("row")
    scored = parts.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("n_best", "count_sum")]
    return found.drop("pairs", "times").join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *numbers, "groups_sha256"
    )
