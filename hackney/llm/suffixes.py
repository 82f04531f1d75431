"""Suffix arrays by induced sorting, with numpy, and the common prefixes of neighbours.

A suffix is S if it is smaller than the next one, else L; an S behind an L is
leftmost-smaller (LMS). Once the LMS suffixes are in order, one sweep over the
buckets of the first letters puts the L suffixes in order and one sweep back the
S suffixes. To order the LMS suffixes, the same two sweeps first sort the LMS
substrings; each gets its rank as a name, and if names repeat, the string of
names is sorted by recursion.

A sweep visits a bucket's suffixes together: what precedes them goes to the
buckets' next free places in one stable move. Only a run of one letter needs
another round in its own bucket. That serves an alphabet of some thousand
letters; where the names of a recursion are more, their string is sorted by
doubling ranks instead.
"""

from __future__ import annotations

import numpy as np

#: Letters from which a string of names is sorted by doubling.
MOST_LETTERS = 4096


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The end counts as smaller than any letter, so the last suffix is L."""
    n = len(text)
    differs = np.empty(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    smaller = np.zeros(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    # A letter equal to the next one has the next one's type.
    at = np.where(differs, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    return smaller[decides]


def _append(out: np.ndarray, free: np.ndarray, letters: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts suffixes at the next free places of their buckets, in the order given."""
    order = np.argsort(letters, kind="stable")
    ordered = letters[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    counts = np.diff(starts, append=len(ordered))
    within = np.arange(len(ordered)) - np.repeat(starts, counts)
    out[free[ordered] + step * within] = found[order]
    free[ordered[starts]] += step * counts


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes, in order if `lms` is; else in the order of their LMS substrings."""
    n = len(text)
    sizes = np.bincount(text, minlength=letters)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    out = np.full(n, -1, np.int64)
    # LMS suffixes by first letter, to be met after the L suffixes of their bucket.
    own = lms[np.argsort(text[lms], kind="stable")]
    bounds = np.searchsorted(text[own], np.arange(letters + 1))
    used = np.flatnonzero(sizes)
    free = heads.copy()
    # The last suffix is preceded by nothing smaller, so it starts its bucket.
    last = np.array([n - 1])
    _append(out, free, text[last], last, 1)
    for letter in used:
        begin = heads[letter]
        while begin < free[letter]:
            end = free[letter]
            before = out[begin:end] - 1
            begin = end
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                _append(out, free, text[before], before, 1)
        before = own[bounds[letter] : bounds[letter + 1]] - 1
        if len(before):  # what precedes an LMS suffix is L and greater
            _append(out, free, text[before], before, 1)
    large_ends = free.copy()
    free = ends - 1
    for letter in used[::-1]:
        # S suffixes of this bucket come last first, then its L suffixes, also last first.
        end = ends[letter] - 1
        while end > free[letter]:
            begin = free[letter]
            before = out[begin + 1 : end + 1][::-1] - 1
            end = begin
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                _append(out, free, text[before], before, -1)
        before = out[heads[letter] : large_ends[letter]][::-1] - 1
        before = before[before >= 0]
        before = before[smaller[before]]
        if len(before):
            _append(out, free, text[before], before, -1)
    return out


def _doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the length that ranks tell apart; only suffixes with a shared rank are sorted again."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    # A suffix's rank is the place of the first suffix that it is not told apart from.
    new = np.ones(n, bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    length = 1
    while not new.all():
        shared = np.flatnonzero(~new | np.append(~new[1:], False))
        some = order[shared]
        follow = np.where(some + length < n, rank[np.minimum(some + length, n - 1)], -1)
        by = np.lexsort((follow, rank[some]))
        some, follow = some[by], follow[by]
        order[shared] = some
        same = np.zeros(len(some), bool)
        same[1:] = (rank[some[1:]] == rank[some[:-1]]) & (follow[1:] == follow[:-1])
        new[shared] = ~same
        rank[some] = np.maximum.accumulate(np.where(same, 0, shared))
        length *= 2
    return order


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Starts of the suffixes of `text` (numbers below `letters`) in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64) if letters > 65536 else text.astype(np.uint16)
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        sorted_ = _induce(text, smaller, lms, letters)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = sorted_[is_lms[sorted_]]
        names, count = _names(text, lms, by_substring)
        if count < len(lms):
            ranks = suffix_array(names, count) if count <= MOST_LETTERS else _doubled(names)
            lms = lms[ranks]
        else:
            lms = by_substring
    return _induce(text, smaller, lms, letters)


def _names(text: np.ndarray, lms: np.ndarray, by_substring: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each LMS substring, in text order; equal substrings share one."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(lms, append=n - 1) + 1  # up to and with the next LMS letter, or to the end
    ends_text = by_substring == lms[-1]  # the end of the text follows it, so it equals no other
    a, b = by_substring[:-1], by_substring[1:]
    same = (length[a] == length[b]) & ~ends_text[:-1] & ~ends_text[1:]
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        left = left[length[a[left]] > step]
        equal = text[a[left] + step] == text[b[left] + step]
        same[left[~equal]] = False
        left = left[equal]
        step += 1
    rank = np.empty(n, np.int64)
    rank[by_substring] = np.cumsum(np.append(True, ~same)) - 1
    return rank[lms], int((~same).sum()) + 1


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each start, letters that its suffix shares with the one before it in order; `most` at most.

    Eight letters are compared at a time, for all starts that still agree.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + most + 8, np.uint8)
    padded[:n] = text
    eight = np.lib.stride_tricks.as_strided(padded, (n + most, 8), (1, 1))
    words = np.ascontiguousarray(eight).view(np.uint64).ravel()
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(before >= 0)
    step = 0
    while len(left) and step < most:
        differs = words[left + step] ^ words[before[left] + step]
        low = differs & (~differs + np.uint64(1))
        same = np.where(differs == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        shared[left] += same
        left = left[same == 8]
        step += 8
    ends = np.maximum(np.arange(n), before)  # the later of the two ends first
    return np.minimum(np.minimum(shared, most), n - ends)
