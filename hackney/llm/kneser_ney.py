"""Modified Kneser-Ney model of sequences of symbols, kept in sorted arrays.

The symbols of a text are the units of its UTF-16 form: one for a character, two
for one beyond the first 65,536, and no two characters share a form. Texts are read
without case, with a space for white space of all kinds and 0 for the digits 0 to 9,
so that numbers and keys do not count as another language. The hash of a run of
`ORDER` symbols puts their sixteen bits together, so that it fits into 64 bits and
no two runs share one. The number of runs follows the corpus; models too large for
arrays of one machine are tables (`kneser_ney_tables`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

ORDER = 4
BITS = 16
SYMBOLS = 1 << BITS
#: Symbols that are worked on at a time; longer texts are taken in blocks that share their borders.
BLOCK = 1 << 20

# The characters that count as a space.
_SPACES = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000]


@cache
def _symbol_table() -> np.ndarray:
    """Symbol of each unit of UTF-16."""
    table = np.arange(SYMBOLS, dtype=np.uint16)
    table[_SPACES] = ord(" ")
    table[ord("0") : ord("9") + 1] = ord("0")
    return table


def mask(length: int) -> int:
    """The bits of the last `length` symbols of a run."""
    return (1 << (BITS * length)) - 1


def hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the runs that end at each symbol, and the text each is of, for about `BLOCK` symbols at a time."""
    parts: list[tuple[int, np.ndarray]] = []
    held = 0
    for owner, text in enumerate(texts):
        units = np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-16-le", "surrogatepass"), np.uint16)
        for start in range(0, len(units) - ORDER + 1, BLOCK):
            parts.append((owner, units[start : start + BLOCK + ORDER - 1]))
            held += len(parts[-1][1])
            if held >= BLOCK:
                yield _hashes(parts)
                parts, held = [], 0
    if parts:
        yield _hashes(parts)


def _hashes(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    symbols = _symbol_table()[np.concatenate([part for _, part in parts])].astype(np.uint64)
    code = symbols[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        code |= symbols[ORDER - 1 - back : len(symbols) - back] << np.uint64(BITS * back)
    sizes = np.array([len(part) - ORDER + 1 for _, part in parts])
    # Of every part, the runs that end in its margin are left out.
    begins = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    places = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return code[places], np.repeat(np.array([owner for owner, _ in parts]), sizes)


class Tally:
    """Counts of hashes, as sorted arrays that are merged when they have grown."""

    def __init__(self, most: int = 1 << 21):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, codes: np.ndarray) -> None:
        found, counts = np.unique(codes, return_counts=True)
        self.parts.append((found, counts.astype(np.int64)))
        self.held += len(found)
        if self.held > self.most:
            self.parts = [self.merged()]
            self.held = 0

    def size(self) -> int:
        return sum(len(codes) for codes, _ in self.parts)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        codes, counts = (np.concatenate(arrays) for arrays in zip(*self.parts, strict=True))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[first], np.add.reduceat(counts, first)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1, 2 and 3 or more."""
    return discounts_of(*(int((counts == times).sum()) for times in range(1, 5)))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """From how many counts are 1 to 4: the usual estimate, or half of each count where that is not in range."""
    if min(n1, n2, n3, n4) > 0:
        share = n1 / (n1 + 2 * n2)
        found = np.array([1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3])
        if (found > 0).all() and (found < [1, 2, 3]).all():
            return found
    return np.array([0.5, 1.0, 1.5])


@dataclass(frozen=True)
class Level:
    """Runs of one length with the log of their probability after the symbols before, and the log of what is left for others."""

    runs: np.ndarray
    log_probability: np.ndarray
    contexts: np.ndarray
    log_left: np.ndarray


@dataclass(frozen=True)
class Model:
    levels: list[Level]  # from runs of one symbol to runs of `ORDER`

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural logs; runs that the model has not seen get what is left, times that of the shorter run."""
        codes, places = np.unique(codes.astype(np.uint64), return_inverse=True)
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for length in range(len(self.levels), 0, -1):
            level = self.levels[length - 1]
            wanted = codes[left] & np.uint64(mask(length))
            place, known = find(level.runs, wanted)
            out[left[known]] += level.log_probability[place[known]]
            left, wanted = left[~known], wanted[~known]
            if not len(left):
                return out[places]
            place, known = find(level.contexts, wanted >> np.uint64(BITS))
            out[left[known]] += level.log_left[place[known]]
        out[left] -= np.log(SYMBOLS)
        return out[places]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def build(codes: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counted runs. Shorter runs count by how many symbols they have been seen after."""
    tables = [(codes.astype(np.uint64), counts.astype(np.int64))]
    for length in range(ORDER - 1, 0, -1):
        longer = tables[0][0]
        runs, seen = np.unique(longer & np.uint64(mask(length)), return_counts=True)
        tables.insert(0, (runs, seen.astype(np.int64)))
    levels: list[Level] = []
    shorter_p = np.zeros(0)
    for length, (runs, seen) in enumerate(tables, 1):
        off = discounts(seen)
        contexts, owner = np.unique(runs >> np.uint64(BITS), return_inverse=True)
        whole = np.bincount(owner, seen, len(contexts))
        taken = off[np.minimum(seen, 3) - 1] if len(seen) else np.zeros(0)
        left = np.bincount(owner, taken, len(contexts)) / np.maximum(whole, 1)
        if length == 1:
            below = np.full(len(runs), 1 / SYMBOLS)
        else:
            place, _ = find(tables[length - 2][0], runs & np.uint64(mask(length - 1)))
            below = shorter_p[place]
        shorter_p = (seen - taken) / whole[owner] + left[owner] * below if len(runs) else np.zeros(0)
        levels.append(Level(runs, np.log(shorter_p), contexts, np.log(np.maximum(left, 1e-300))))
    return Model(levels)
