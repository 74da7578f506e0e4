"""Suffix arrays by induced sorting, and common prefixes of neighbours in them."""

from __future__ import annotations

import numpy as np

#: A reduced text whose names are nearly all different (fewer than so many places a name) is sorted by doubling ranks.
PLACES_A_NAME = 24


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of ``text`` (non-negative integers) in their order.

    Induced sorting: suffixes are classed as smaller (S) or larger (L) than the next; the substrings between leftmost S places are
    sorted by induction and named; the text of names is sorted by recursion; and from its order one pass up and one down
    the buckets induce the order of all. A pass handles one bucket at a time: all suffixes in it
    send their left neighbours to their buckets in one vectorised step, so its work is linear in the text.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    s = np.append(text.astype(np.int64) + 1, 0)  # an end mark smaller than all
    return _sort(s.astype(np.uint16) if s.max() < 1 << 16 else s)[1:]


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour; equal symbols follow the next change."""
    n = len(s)
    rises = np.empty(n, bool)
    rises[:-1], rises[-1] = s[:-1] < s[1:], True
    decided = np.append(s[:-1] != s[1:], True)
    place = np.where(decided, np.arange(n), n)
    return rises[np.minimum.accumulate(place[::-1])[::-1]]


class _Buckets:
    def __init__(self, s: np.ndarray, small: np.ndarray):
        self.s, self.small = s, small
        self.size = np.bincount(s)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.used = np.flatnonzero(self.size)

    def induce(self, left: np.ndarray) -> np.ndarray:
        """All suffixes in order, given leftmost S places in (some) order: L ones upwards, then S ones downwards."""
        s, small = self.s, self.small
        order = np.full(len(s), -1, np.int64)
        symbols = s[left]
        group = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=len(self.size))
        seeds = self.end - counts  # where the seeds of a bucket begin
        sent = symbols[group]
        rank = np.arange(len(left)) - np.repeat((np.cumsum(counts) - counts)[self.used], counts[self.used])
        order[seeds[sent] + rank] = left[group]
        head = self.start.copy()

        def send(batch: np.ndarray, up: bool) -> None:
            before = batch[batch > 0] - 1
            before = before[small[before] != up]
            if not len(before):
                return
            c = s[before]
            by = np.argsort(c, kind="stable")
            c, before = c[by].astype(np.int64), before[by]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            count = np.diff(np.append(first, len(c)))
            rank = np.arange(len(c)) - np.repeat(first, count)
            if up:
                order[head[c] + rank] = before
                head[c[first]] += count
            else:
                order[tail[c] - 1 - rank] = before
                tail[c[first]] -= count

        for b in self.used:
            at = self.start[b]
            while at < head[b]:
                at, batch = head[b], order[at : head[b]]
                send(batch, True)
            if counts[b]:
                send(order[seeds[b] : self.end[b]], True)
        large_end = head
        tail = self.end.copy()
        for b in self.used[::-1]:
            at = self.end[b]
            while at > tail[b]:
                at, batch = tail[b], order[tail[b] : at][::-1]
                send(batch, False)
            if large_end[b] > self.start[b]:
                send(order[self.start[b] : large_end[b]][::-1], False)
            if b == 0:
                order[0] = len(s) - 1
        return order


def _sort(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text that ends with its only smallest symbol 0."""
    n = len(s)
    small = _types(s)
    left = np.flatnonzero(small & ~np.concatenate([[True], small[:-1]]))
    buckets = _Buckets(s, small)
    rough = buckets.induce(left)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    rough = rough[is_left[rough]]
    names, different = _names(s, left, rough)
    if different == len(left):
        return buckets.induce(rough)
    reduced = names[left]
    inner = _doubling(reduced) if len(reduced) < PLACES_A_NAME * different else _sort(reduced.astype(np.uint16) if different < 1 << 16 else reduced)
    return buckets.induce(left[inner])


def _names(s: np.ndarray, left: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the sorted substrings from each leftmost S place to the next; equal substrings share one."""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[left] = np.append(np.diff(left), 0) + 1
    a, b = rough[:-1], rough[1:]
    same = length[a] == length[b]
    same[0:1] = False  # the end mark stands alone
    check, at = np.flatnonzero(same), 0
    while len(check):
        equal = s[a[check] + at] == s[b[check] + at]
        same[check[~equal]] = False
        at += 1
        check = check[equal]
        check = check[length[a[check]] > at]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(n, np.int64)
    names[rough] = rank
    return names, int(rank[-1]) + 1


def _doubling(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes by ranks of twice the length in every round."""
    n = len(s)
    rank, step = s.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every place the length of the prefix that its suffix shares with the one before it in the order (text: bytes).

    If the symbols before a suffix and its neighbour are equal, the length is one less than that of the place to the left.
    So only the other places are compared, eight bytes at a time, and all others follow.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), np.dtype("<u8"), padded.data, 0, (1,))
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = text[at[follows] - 1] == text[before[follows] - 1]
    own = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    check = own[before[own] >= 0]
    while len(check):
        i, j = check + length[check], before[check] + length[check]
        inside = (i < n) & (j < n)
        check, i, j = check[inside], i[inside], j[inside]
        differ = eight[i] ^ eight[j]
        whole = differ == 0
        low = differ[~whole] & (~differ[~whole] + np.uint64(1))
        length[check[~whole]] += np.log2(low.astype(np.float64)).astype(np.int64) // 8
        length[check[whole]] += 8
        check = check[whole]
    source = np.zeros(n, np.int64)
    source[own] = own
    source = np.maximum.accumulate(source)
    length = length[source] - (at - source)
    return np.minimum(np.maximum(length, 0), n - np.maximum(at, before))
