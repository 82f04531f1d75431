"""Repeated byte strings, by suffix arrays of shards.

A string is `LENGTH` neighbouring bytes of one text. Its minimizer is the first
`GRAM`-byte run in it with the least hash, so equal strings have equal ones at the
same distance from their start. Strings that start at neighbouring bytes and share
one, at one place, lie in one stretch of text; no two of them are equal.

1. Minimizers of stretches are counted in a count-min sketch, so stretches whose
   minimizer occurs once are left where they are. Minimizers of very many different
   stretches are listed as well.
2. The other stretches are sent to the shard of their minimizer, equal ones of a
   task's piece of input only once. Stretches of a listed minimizer are cut into
   classes of that distance. All strings of a class cover the same bytes around the
   minimizer; the hash of these names the shard, and so contexts spread over shards.
3. A shard settles equal stretches. Of those that differ but share a minimizer, it
   keeps the strings whose hash occurs twice among them and settles equal stretches
   of these. Of what is left it builds the suffix array by induced sorting, and the
   permuted common prefixes. Suffixes that share `LENGTH` bytes with their neighbour
   hold one string; all but the first in order repeat it.

Every byte that a repeat covers is removed; strings are judged on the input.
Occurrences are ordered by doc_id (null first), then a hash of the text, then
start; rows that share doc_id and text are one place and do not repeat each
other. Null and empty texts have no bytes. An empty table gives an empty result.
Matches are of bytes, so what is kept of a text need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.llm import sketch
from hackney.llm.common import CHUNK_BYTES, Ranges, keyed_texts, mix, partitions_for, slices, texts
from hackney.llm.marks import PACKED, packed, with_marks
from hackney.llm.substring_dedup import by_place, message, runs_of, settled_part, settled_rows, text_bytes
from hackney.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH = 100
GRAM = 24
#: The sketch: rows, cells per byte of text in each, and log2 of the most cells of a row.
SKETCH_ROWS = 2
CELLS_PER_BYTE = 0.1
MOST_BITS = 30
#: Strings whose minimizers are worked out at a time, so few that a processor's cache holds all that is made of them.
BLOCK = 1 << 15
#: A minimizer of more different stretches than this is frequent; each task lists this many at most, and so does the broadcast.
FREQUENT = 4096
MOST_LISTED = 1 << 16
#: Stretches of which a task knows the different ones, to count them; beyond that some count again.
MOST_KNOWN = 1 << 20
#: Bytes of text of which equal stretches are sent once.
PIECE_BYTES = 2 * CHUNK_BYTES
#: Bytes of text for which there is one shard, shards of a task, and bytes that a suffix array is built of at a time.
BYTES_PER_SHARD = 16 << 20
SHARDS_PER_TASK = 4
ARRAY_BYTES = 1 << 21

_BASE = 0xA0761D6478BD642F
_SPREAD = np.uint64(0xE7037ED1A0B428DB)
# Marks that are settled already travel with the stretches, in rows without them.
_SENT = (
    "bucket int, stretches binary, lengths binary, minimizers binary, doc binary, place binary, keys binary, ties binary, "
    "counts binary, marks binary"
)
_NAMES = [column.split()[0] for column in _SENT.split(", ")]
_KINDS = [pa.int32(), *[pa.binary()] * 9]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from the least of twice as many each time."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """First and last string, place and hash of the minimizer, and text of every stretch; hashes of ranges, and their start.

    Blocks overlap by what a string needs, so a long text takes no more memory
    than a short one. Places are given in all of `data`; a stretch is cut where a
    block ends.
    """
    last_start = len(data) - length
    # The low bits of a hash make room for the place, so of equal runs the first is least.
    places = np.uint64((1 << (BLOCK + length).bit_length()) - 1)
    every = np.arange(BLOCK + length, dtype=np.uint64)
    # Whole strings of the texts, which are as many as their bytes but the last ones.
    first = offsets[:-1]
    last = offsets[1:] - length + 1
    long = last > first
    first, last = first[long], last[long]
    for low in range(0, last_start + 1, BLOCK):
        high = min(low + BLOCK, last_start + 1)
        ranges = Ranges(data[low : high + length - 1].astype(np.uint64) + np.uint64(1), _BASE)
        grams = ranges.neighbours(GRAM)
        least = grams >> np.uint64(32)
        least ^= grams
        least *= _SPREAD
        least &= ~places
        least |= every[: len(least)]
        least = _sliding_least(least, length - GRAM + 1)
        here = slice(int(np.searchsorted(last, low, "right")), int(np.searchsorted(first, high)))
        begins, stops = np.maximum(first[here] - low, 0), np.minimum(last[here], high) - low
        if not len(begins):
            continue
        new = np.zeros(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        new[begins] = new[stops] = True
        breaks = np.flatnonzero(new)
        text = np.searchsorted(begins, breaks, "right") - 1
        some = np.flatnonzero((text >= 0) & (breaks < stops[text]))
        starts, ends = breaks[some], breaks[some + 1] - 1
        at = (least[starts] & places).astype(np.int64)
        yield starts + low, ends + low, at + low, mix(grams[at], 5), np.searchsorted(offsets, starts + low, "right") - 1, ranges, low


def _minimizers(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offsets in slices(batches):
            for _, _, _, least, _, _, _ in stretches(data, offsets, length):
                yield least

    return run


def _frequent(rows: DataFrame, repeats: sketch.Repeats, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers of many different stretches, and widths of the classes to cut these into.

    Which ones are found only spreads the work; any list gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = np.zeros((2, 0), np.uint64)
        held, many = [known], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            found, where = np.unique(np.concatenate([values, known[1]]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([counts, np.ones(known.shape[1], np.int64)])).astype(np.int64)
            top = np.argsort(-sums, kind="stable")[: 4 * FREQUENT]
            return found[top], sums[top]

        for _, data, offsets in slices(batches):
            for starts, ends, _, least, _, ranges, low in stretches(data, offsets, length):
                some = np.flatnonzero(repeats.maybe(least))
                held.append(np.stack([ranges.hash(starts[some] - low, ends[some] + length - low, 8), least[some]]))
                many += len(some)
            if many >= MOST_KNOWN // 2:
                known = _once(held)
                if known.shape[1] >= MOST_KNOWN:
                    values, counts = counted()
                    known = known[:, :0]
                held, many = [known], 0
        known = _once(held)
        values, counts = counted()
        keep = counts > 1
        values, counts = values[keep][:FREQUENT], counts[keep][:FREQUENT]
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["minimizer", "n"])

    summed = rows.mapInArrow(run, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))
    top = summed.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "minimizer").limit(MOST_LISTED).collect()
    listed = np.array([row["minimizer"] for row in top], np.int64).view(np.uint64)
    # Halves of the distances, then a power of two for each four times as many; single strings in the end.
    times = np.array([row["n"] // FREQUENT for row in top], np.float64)
    level = np.floor(np.log2(times)).astype(np.int64)
    widths = np.where(level < 8, np.maximum(1, (length - GRAM + 1) >> (1 + level // 2)), 1)
    order = np.argsort(listed)
    return listed[order], widths[order]


def _once(held: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(held, axis=1)
    return pairs[:, np.unique(pairs[0], return_index=True)[1]]


def _cut(starts, ends, at, least, owner, ranges, low, frequent, length):
    """Stretches of frequent minimizers are cut by the distance of their strings; others stay. The minimizer names the shard."""
    listed, widths = frequent
    if not len(listed):
        return starts, ends, least, owner
    spot = np.minimum(np.searchsorted(listed, least), len(listed) - 1)
    often = listed[spot] == least
    width, minimizers = widths[spot[often]], at[often]
    first, last = (minimizers - ends[often]) // width, (minimizers - starts[often]) // width
    many = last - first + 1
    which = np.repeat(np.arange(len(many)), many)
    part = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    nearest = part * width[which]
    farthest = np.minimum(nearest + width[which] - 1, length - GRAM)
    place = minimizers[which]
    shared = ranges.hash(place - nearest - low, place - farthest + length - low, 7)
    cut = (
        np.maximum(starts[often][which], place - farthest),
        np.minimum(ends[often][which], place - nearest),
        mix(shared ^ least[often][which] ^ part.astype(np.uint64), 7),
        owner[often][which],
    )
    return tuple(np.concatenate([a[~often], b]) for a, b in zip((starts, ends, least, owner), cut, strict=True))


def _spans(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners, and starts and ends, of the bytes that these cover; in order, spans that meet are one."""
    order = np.lexsort((starts, owner))
    owner, starts, ends = owner[order], starts[order], ends[order]
    if not len(owner):
        return owner, np.zeros((0, 2), np.int64)
    # Owners one after the other: a start beyond all ends before it begins a span.
    shift = owner.astype(np.int64) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift)
    new = np.append(True, (starts + shift)[1:] > reach[:-1]) | np.append(True, owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    stops = (reach - shift)[np.append(first[1:], len(owner)) - 1]
    return owner[first], np.stack([starts[first], stops], axis=1)


def _leaders(parts: Iterator[bytes], many: int) -> tuple[np.ndarray, list[bytes]]:
    """For each part the number of the first equal one; and the different parts."""
    seen: dict[bytes, int] = {}
    leaders = np.fromiter((seen.setdefault(part, i) for i, part in enumerate(parts)), np.int64, many)
    return leaders, list(seen)


def _send(repeats: sketch.Repeats, frequent: tuple[np.ndarray, np.ndarray], length: int, buckets: int):
    """Stretches that may hold a repeat, by shard; and stretches that repeat one of the same piece, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, data, offsets in slices(batches, PIECE_BYTES):
            found = []
            for *stretch, ranges, low in stretches(data, offsets, length):
                some = np.flatnonzero(repeats.maybe(stretch[3]))
                found.append(_cut(*(column[some] for column in stretch), ranges, low, frequent, length))
            if not sum(len(part[0]) for part in found):
                continue
            keys, ties, rank = by_place(batch)
            start, end, minimizer, text = (np.concatenate(column) for column in zip(*found, strict=True))
            del found
            # A row that is there twice is one place.
            only = np.zeros(len(rank), bool)
            only[np.unique(rank, return_index=True)[1]] = True
            place = start - offsets[text]
            order = np.lexsort((place, rank[text]))
            order = order[only[text[order]]]
            start, minimizer, text, place = start[order], minimizer[order], text[order], place[order]
            stop = end[order] + length
            raw = data.tobytes()
            leaders, parts = _leaders((raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)), len(start))
            again = np.flatnonzero(leaders != np.arange(len(leaders)))
            doc, spans = _spans(text[again], place[again], place[again] + stop[again] - start[again])
            # Marks of a document are neighbours, whatever the order of the rows.
            rows = settled_rows(keys[doc], ties[doc], spans, buckets)
            own = np.flatnonzero(leaders == np.arange(len(leaders)))
            bucket = (mix(minimizer[own], 9) >> np.uint64(32)).astype(np.int64) * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            for a, b in runs_of(bucket[order]):
                some = order[a:b]
                part = own[some]
                rows_, doc = np.unique(text[part], return_inverse=True)
                rows.append(
                    {
                        "bucket": int(bucket[some[0]]),
                        "stretches": packer.compress(b"".join([parts[i] for i in some.tolist()])),
                        "lengths": (stop[part] - start[part]).astype(np.uint32).tobytes(),
                        "minimizers": minimizer[part].tobytes(),
                        "doc": doc.astype(np.uint32).tobytes(),
                        "place": place[part].tobytes(),
                        "keys": keys[rows_].tobytes(),
                        "ties": ties[rows_].tobytes(),
                    }
                )
            yield message(rows, _NAMES, _KINDS)

    return run


def _repeats_in(parts: list[bytes], docs: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and start of strings that an earlier place holds too, in order. Parts are in the order of their places."""
    sizes = np.array([len(part) for part in parts])
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(parts), np.uint8)
    order = suffix_array(text, 256)
    shared = permuted_common_prefixes(text, order, length)
    part = np.repeat(np.arange(len(parts)), sizes)
    within = np.arange(len(text)) - begins[part]
    fits = sizes[part] - within >= length  # up to the end of the own stretch
    # Suffixes too near to the end of their stretch are no strings; those between share no less.
    order = order[fits[order] | (shared[order] < length)]
    group = np.cumsum(shared[order] < length)
    some = fits[order]
    order, group = order[some], group[some]
    least = np.full(int(group.max(initial=0)) + 1, len(text))
    np.minimum.at(least, group, order)
    first = least[group]
    # Rows that share doc_id and text are one place, and may be cut in two ways.
    place = places[part] + within
    later = np.sort(order[(place[order] != place[first]) | (docs[part[order]] != docs[part[first]])])
    return part[later], within[later]


def _twice(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and start, in order, of strings whose hash occurs more than once."""
    owners, starts, hashes = [], [], []
    sizes = np.array([len(part) for part in parts])
    ends = np.cumsum(sizes)
    first = 0
    while first < len(parts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + BLOCK, "right")))
        data = np.frombuffer(b"".join(parts[first:last]), np.uint8)
        many = sizes[first:last] - length + 1
        owner = np.repeat(np.arange(first, last), many)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        at = start + ends[owner] - sizes[owner] - (ends[first] - sizes[first])
        owners.append(owner)
        starts.append(start)
        hashes.append(Ranges(data.astype(np.uint64) + np.uint64(1), _BASE).neighbours(length)[at])
        first = last
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.concatenate(owners)[twice], np.concatenate(starts)[twice]


def _batches(minimizers: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of stretches that share their minimizer with another, in order; about `most` bytes each time, a minimizer's together."""
    _, which, counts = np.unique(minimizers, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    order = order[counts[which[order]] > 1]
    ends = np.cumsum(sizes[order])
    edges = np.append(np.flatnonzero(np.diff(which[order])) + 1, len(order))
    first = 0
    while first < len(order):
        last = edges[min(np.searchsorted(ends[edges - 1], ends[first] - sizes[order[first]] + most), len(edges) - 1)]
        yield np.sort(order[first:last])
        first = last


def _shard(sent: pa.Table) -> tuple[np.ndarray, ...]:
    """Minimizer, key, tie, place, start and end of a shard's stretches, and their bytes."""
    rows, raw = [], []
    unpacker = zstandard.ZstdDecompressor()
    for at in range(sent.num_rows):
        of = {name: sent.column(name)[at].as_py() for name in _NAMES[1:8]}
        doc = np.frombuffer(of["doc"], np.uint32)
        keys, ties = np.frombuffer(of["keys"], np.int64)[doc], np.frombuffer(of["ties"], np.int64)[doc]
        minimizers, place = np.frombuffer(of["minimizers"], np.uint64), np.frombuffer(of["place"], np.int64)
        rows.append((minimizers, keys, ties, place, np.frombuffer(of["lengths"], np.uint32).astype(np.int64)))
        raw.append(unpacker.decompress(of["stretches"]))
    minimizers, keys, ties, place, lengths = (np.concatenate(column) for column in zip(*rows, strict=True))
    ends = np.cumsum(lengths)
    return minimizers, keys, ties, place, ends - lengths, ends, b"".join(raw)


def _settle(length: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        passed = settled_part(table)
        sent = table.filter(pa.compute.is_valid(table.column("lengths")))
        if not sent.num_rows:
            return passed
        minimizers, keys, ties, place, starts, ends, raw = _shard(sent)
        order = np.lexsort((place, ties, keys))
        minimizers, keys, ties, place = minimizers[order], keys[order], ties[order], place[order]
        new = np.append(True, (np.diff(keys) != 0) | (np.diff(ties) != 0))
        doc = np.cumsum(new) - 1
        keys, ties = keys[new], ties[new]
        marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settled(parts: Iterator[bytes], doc: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
            """Marks parts that an earlier place holds too; numbers and bytes of the others."""
            leaders, different = _leaders(parts, len(doc))
            again = (doc[leaders] != doc) | (place[leaders] != place)
            marks.append((doc[again], place[again], place[again] + sizes[again]))
            return np.flatnonzero(leaders == np.arange(len(leaders))), different

        pieces = zip(starts[order].tolist(), ends[order].tolist(), strict=True)
        own, parts = settled((raw[a:b] for a, b in pieces), doc, place, (ends - starts)[order])
        del raw, pieces
        minimizers, doc, place = minimizers[own], doc[own], place[own]
        sizes = np.array([len(part) for part in parts])
        for some in _batches(minimizers, sizes, 4 * ARRAY_BYTES):
            # Strings of a stretch are neighbours, so those that may repeat are taken with all between them.
            owner, start = _twice([parts[i] for i in some.tolist()], length)
            if not len(owner):
                continue
            edges = np.flatnonzero(np.append(True, np.diff(owner) != 0))
            some, low = some[owner[edges]], start[edges]
            high = start[np.append(edges[1:], len(start)) - 1] + length
            doc_, place_ = doc[some], place[some] + low
            rest = (parts[i][a:b] for i, a, b in zip(some.tolist(), low.tolist(), high.tolist(), strict=True))
            left, few = settled(rest, doc_, place_, high - low)
            some, doc_, place_, sizes_ = some[left], doc_[left], place_[left], (high - low)[left]
            for among in _batches(minimizers[some], sizes_, ARRAY_BYTES):
                part, at = _repeats_in([few[i] for i in among.tolist()], doc_[among], place_[among], length)
                at = at + place_[among][part]
                marks.append((doc_[among][part], at, at + length))
        marked, spans = _spans(*(np.concatenate(column) for column in zip(*marks, strict=True)))
        found = packed(keys[marked], ties[marked], spans, buckets)
        return pa.concat_tables([passed, pa.Table.from_batches([found])])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packed starts and ends of bytes that an earlier place holds too."""
    rows = keyed_texts(docs).select("key", "tie", "text")
    size = text_bytes(rows)
    bits = sketch.width_bits(int(size * CELLS_PER_BYTE), 1, MOST_BITS)
    plain = texts(docs).select("text")
    counted = sketch.repeats(plain, _minimizers(length), rows=SKETCH_ROWS, bits=bits)
    frequent = _frequent(plain, counted, length)
    buckets = max(partitions_for(docs), size // BYTES_PER_SHARD + 1)
    sent = rows.mapInArrow(_send(counted, frequent, length, buckets), _SENT)
    tasks = max(partitions_for(docs), buckets // SHARDS_PER_TASK)
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_settle(length, buckets), PACKED)


def kept_bytes(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or their SHA-256) of every row."""
    name, kind = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            raw = data.tobytes()
            sizes, lost, spans_, kept = [], [], [], []
            for begin, end, marks in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("marks").to_pylist(), strict=True):
                text = raw[begin:end]
                gone = np.frombuffer(marks or b"", np.int64).reshape(-1, 2)
                gone = gone[np.argsort(gone[:, 0], kind="stable")]
                reach = np.maximum.accumulate(gone[:, 1]) if len(gone) else gone[:, 1]
                new = np.flatnonzero(np.append(True, gone[1:, 0] > reach[:-1])) if len(gone) else np.zeros(0, np.int64)
                starts = gone[new, 0].tolist()
                stops = reach[np.append(new[1:], len(gone)) - 1].tolist() if len(gone) else []
                stay = b"".join([text[a:b] for a, b in zip([0, *stops], [*starts, len(text)])])
                sizes.append(len(text))
                lost.append(len(text) - len(stay))
                spans_.append(len(starts))
                kept.append(hashlib.sha256(stay).hexdigest() if digest else stay)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(column, pa.int64()) for column in (sizes, lost, spans_)), pa.array(kept, kind)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", name],
            )

    columns = f"n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}"
    return with_marks(docs, repeated_spans(docs, length), run, columns)
