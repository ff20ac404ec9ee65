"""Suffix arrays, common prefixes, and a compressed full-text index, in numpy."""

from __future__ import annotations

import numpy as np

from .arrays import eights


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of t (small non-negative integers) by Larsson-Sadakane refinement: each round multiplies the
    sorted depth, by three where three ranks fit in a word, and touches only groups that are still tied."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32), np.zeros(n, np.int32)
    width = max(1, (int(t.max()) + 1).bit_length())
    h = max(1, min(62 // width, n))
    key = np.zeros(n, np.int64)
    for at in range(h):
        key <<= width
        key[: n - at] += t[at:]
        key[: n - at] += 1
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    place = np.arange(n, dtype=np.int32)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    tied = place[~(new & np.append(new[1:], True))]
    times = 3 if 3 * (n + 1).bit_length() <= 63 else 2
    while len(tied):
        at = order[tied]
        key = rank[at].astype(np.int64)
        for step in range(1, times):
            key *= n + 1
            key += rank[np.minimum(at.astype(np.int64) + step * h, n)]
            key += 1
        inner = np.argsort(key)
        at, key = at[inner], key[inner]
        order[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        h *= times
    return order, rank[:n]


def kasai(t: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For the ``counts`` positions from each of ``starts``: the common prefix with the suffix before it in order, up to most.

    t: bytes, of which the ``most`` from these positions are none of 255. Kasai's rule, in step over all runs: from one position to
    the next the common prefix shrinks by one at most."""
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    view = eights(t, most + 16)
    lcp = np.zeros(n, np.int32)
    by_count = np.argsort(-counts, kind="stable")  # runs that end leave at the end
    starts, counts = starts[by_count], counts[by_count]
    h = np.zeros(len(starts), np.int64)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, "left"))
        p = starts[:live] + step
        q = before[p].astype(np.int64)
        got = np.where(q >= 0, np.maximum(h[:live] - 1, 0), 0)
        todo = np.flatnonzero((q >= 0) & (got < most))
        while len(todo):
            at = got[todo]
            differ = view[p[todo] + at] ^ view[q[todo] + at]
            # the lowest bit that differs lies in the first byte that does
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            got[todo] = np.minimum(at + same, most)
            todo = todo[(same == 8) & (at + 8 < most)]
        h[:live] = got
        lcp[p] = got
    return lcp


class Bits:
    """Packed bits with ranks: a count before each 64-bit word and a population count inside it."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of t, held as a wavelet matrix. The last symbol of t is 0, and nowhere else.

    The suffix array goes once the transform is made; of it stays, for each suffix in order, the label of its place (``labels``)."""

    def __init__(self, t: np.ndarray, labels: np.ndarray):
        order, _ = suffix_array(t)
        bwt, self.labels = t[order - 1], labels[order]
        del order
        self.size, self.symbols = len(t), int(t.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.symbols))])
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, (self.symbols - 1).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (bwt >> level) & 1 > 0
            zeros = int((~bit).sum())
            self.levels.append((Bits(bit), zeros))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        every = np.arange(self.symbols)
        self.base = self._down(every, np.zeros(self.symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for number, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where((c >> (self.depth - 1 - number)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the transform before i."""
        return self._down(c, i) - self.base[c]

    def search(self, t: np.ndarray, at: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin as t[at : at + k]; symbols that the index lacks are negative.

        Matching statistics stop at the threshold k, and for windows of the index itself (own) where only themselves are left."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
        live = np.arange(len(at))
        for step in range(k - 1, -1, -1):
            c = t[at[live] + step]
            known = c >= 0
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            left = high[live] - low[live]
            live = live[(left > 1) | ((left == 1) & ~own[live])]
            if not len(live):
                break
        return low, high

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest label of each interval. Intervals of two suffixes or more are of equally long strings: equal or apart."""
        out = self.labels[low]
        wide = np.flatnonzero(high - low > 1)
        if len(wide):
            begin, first, back = np.unique(low[wide], return_index=True, return_inverse=True)
            stop = high[wide][first]
            bounds = np.stack([begin, stop], 1).ravel()
            out[wide] = np.minimum.reduceat(np.append(self.labels, self.labels[-1]), bounds)[::2][back]
        return out
