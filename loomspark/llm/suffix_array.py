"""Suffix arrays by induced sorting (doubling for reduced texts), and permuted common prefixes, over numpy arrays."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket with array operations; the shorter texts of more
#: symbols that induction leaves are sorted by doubling.
_SMALL = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the one after). The last symbol must be the only least."""
    n = len(t)
    after = np.empty(n, np.int64)
    after[-1] = n - 1
    change = np.flatnonzero(t[:-1] != t[1:])
    ends = np.append(change, n - 1)  # last place of each run
    last = np.repeat(ends, np.diff(ends, prepend=-1))
    s = np.ones(n, bool)
    inner = last < n - 1
    s[inner] = t[last[inner]] < t[last[inner] + 1]
    return s


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """The rank of each leftmost-smaller substring, equal ones alike, and the number of ranks."""
    m = len(lms)
    key = t.astype(np.int64) * 2 + s + 1
    bits = int(symbols * 2 + 2).bit_length()
    per = max(1, 62 // bits)
    lengths = np.empty(m, np.int64)
    lengths[:-1] = np.diff(lms) + 1
    lengths[-1] = 1
    padded = np.concatenate([key, np.zeros(per, np.int64)])
    rank = np.zeros(m, np.int64)
    open_, at = np.arange(m), 0
    while len(open_):
        word = np.zeros(len(open_), np.int64)
        for k in range(per):
            inside = at + k < lengths[open_]
            word = word << bits | np.where(inside, padded[np.minimum(lms[open_] + at + k, len(key))], 0)
        order = np.lexsort((word, rank[open_]))
        r, w = rank[open_][order], word[order]
        fresh = np.concatenate([[False], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
        head = np.concatenate([[True], r[1:] != r[:-1]])
        # ranks are places in the order, so groups can be refined on their own
        place = np.arange(len(r))
        base = np.maximum.accumulate(np.where(head, place, 0))
        start = np.maximum.accumulate(np.where(fresh | head, place, 0))
        new = r + start - base
        rank[open_[order]] = new
        at += per
        starts = np.flatnonzero(fresh | head)
        size = np.diff(np.append(starts, len(r)))
        group = np.repeat(size, size) > 1
        rest = open_[order][group]
        open_ = rest[lengths[rest] > at]
        if len(open_):  # a group goes on as a whole; members that ended stay at its start
            open_ = np.sort(open_)
    used = np.zeros(m, bool)
    used[rank] = True
    return (np.cumsum(used) - 1)[rank], int(used.sum())


def _induce_small(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array from sorted LMS suffixes, one bucket of a first symbol after the other."""
    t = t.astype(np.int16)  # numpy sorts these by their digits
    of = lambda p: np.split(p[(o := np.argsort(t[p], kind="stable"))], np.searchsorted(t[p][o], np.arange(1, symbols)))
    seeds = of(lms)
    left: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    empty = np.empty(0, np.int64)

    def deal(found: np.ndarray, into: list[list[np.ndarray]]) -> None:
        if len(found):
            c = t[found]
            o = np.argsort(c, kind="stable")
            found, c = found[o], c[o]
            cuts = np.flatnonzero(np.diff(c)) + 1
            for part in np.split(found, cuts):
                into[t[part[0]]].append(part)

    for c in range(symbols):
        now = np.concatenate(left[c]) if left[c] else empty
        mine = [now]
        while len(now):  # a run of the symbol itself
            p = now[now > 0] - 1
            now = p[~s[p] & (t[p] == c)]
            mine.append(now)
        left[c] = [np.concatenate(mine)]
        p = np.concatenate([left[c][0], seeds[c]])
        p = p[p > 0] - 1
        deal(p[~s[p] & (t[p] > c)], left)
    right: list[list[np.ndarray]] = [[] for _ in range(symbols)]  # in descending order
    for c in range(symbols - 1, -1, -1):
        now = np.concatenate(right[c]) if right[c] else empty
        mine = [now]
        while len(now):
            p = now[now > 0] - 1
            now = p[s[p] & (t[p] == c)]
            mine.append(now)
        right[c] = [np.concatenate(mine)]
        p = np.concatenate([right[c][0], left[c][0][::-1]])
        p = p[p > 0] - 1
        deal(p[s[p] & (t[p] < c)], right)
    out = [x for c in range(symbols) for x in (left[c][0], right[c][0][::-1])]
    out = np.concatenate(out)
    return np.concatenate([[len(t) - 1], out]) if len(out) < len(t) else out


def _doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array by doubling: groups of suffixes that agree in k symbols are parted by the k after them."""
    n, k = len(t), 1
    order = np.argsort(t, kind="stable")
    r = t[order]
    fresh = np.concatenate([[True], r[1:] != r[:-1]])
    slots = np.arange(n)  # of suffixes in groups of two or more, group by group; none of these reaches the last symbol in k
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
    while True:
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if not len(slots):
            return order
        p = order[slots]
        key = rank[p] * n + rank[p + k]
        o = np.argsort(key)
        p, key = p[o], key[o]
        order[slots] = p
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[p] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))]
        k *= 2


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of ``t`` (values below ``symbols``), whose last symbol must be its only least."""
    if len(t) < 2:
        return np.zeros(len(t), np.int64)
    if symbols > _SMALL:
        return _doubled(t)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    names, n = _names(t, s, lms, symbols)
    if n == len(lms):
        order = np.empty(n, np.int64)
        order[names] = np.arange(n)
    else:
        order = suffix_array(names, n)
    return _induce_small(t, s, lms[order], symbols)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the length that its suffix shares with the one before it in order (symbols < 2 ** 16).

    Where the symbols before the two suffixes are the same, the length is one less than at the place
    before. Only at the other, irreducible, places symbols are compared, four at a time; the sum of their
    lengths is small.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = n  # none
    before = np.concatenate([[-1], t[:-1].astype(np.int64)])
    other = np.where((phi > 0) & (phi < n), before[np.minimum(phi, n - 1)], -2)
    hard = np.flatnonzero((before != other) & (phi < n))
    raw = np.concatenate([t, np.zeros(4, t.dtype)]).astype("<u2").tobytes()
    words = np.ndarray(n + 1, "<u8", raw, strides=(2,))
    length, open_, at = np.zeros(n, np.int64), hard, 0
    while len(open_):
        diff = words[open_ + at] ^ words[phi[open_] + at]
        same = diff == 0
        d = diff[~same]
        low = d & (~d + np.uint64(1))  # the lowest bit
        length[open_[~same]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4)
        open_, at = open_[same], at + 4
    place = np.arange(n)
    known = np.zeros(n, bool)
    known[hard] = True
    known[sa[0]] = True
    base = np.maximum.accumulate(np.where(known, place, 0))
    return np.maximum(length[base] - (place - base), 0)
