"""Words of many texts at once, as positions in their bytes, and hashes of runs of words."""

from __future__ import annotations

import hashlib

import numpy as np

from hackney.llm.common import Ranges, mix

# The bytes between words; space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# Odd numbers, any would do.
_WORD_BASE = (0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)
#: Bytes of the longest word that is hashed with others, eight bytes of all at a time; longer ones are digested alone.
_LONGEST = 256
_LOW_BYTES = np.array([(1 << 8 * many) - 1 for many in range(8)] + [(1 << 64) - 1], np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """With A to Z in lower case."""
    return _LOWER[data]


class Words:
    """Starts and ends of the words of texts that lie one after the other, and the place of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        word = ~_SPACE[data]
        before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        before[1:], after[:-1] = word, word
        edges = offsets[(offsets >= 0) & (offsets <= len(data))]
        before[edges] = False
        self.starts = np.flatnonzero(word & ~before[:-1])
        next_is_word = after[1:].copy()
        next_is_word[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~next_is_word) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """Of each word's bytes; `which` picks one of several independent ones.

        Every eight bytes are mixed into all that came before, so no regularity of
        a word's letters can make two words equal, as it can in sums of powers.
        """
        lengths = self.ends - self.starts
        out = mix(lengths.astype(np.uint64), 21 + which)
        if not len(out):
            return out
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)
        left = np.flatnonzero(lengths <= _LONGEST)
        done = 0
        while len(left):
            part = eight[self.starts[left] + done].view("<u8").ravel()
            part = part & _LOW_BYTES[np.minimum(lengths[left] - done, 8)]
            out[left] = mix(out[left] ^ mix(part, 31 + which), 41 + which)
            done += 8
            left = left[lengths[left] > done]
        for word in np.flatnonzero(lengths > _LONGEST).tolist():
            digest = hashlib.blake2b(self.data[self.starts[word] : self.ends[word]], digest_size=8, salt=bytes([which]))
            out[word] = int.from_bytes(digest.digest(), "little")
        return out


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Of the words in [start, end), from the hashes of the words; `which` picks one of two independent ones."""
    return Ranges(words, _WORD_BASE[which]).hash(starts, ends, 2 + which)


def window_starts(first: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows that lie in one text, and the text that each is of."""
    many = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return first[owner] + within, owner
