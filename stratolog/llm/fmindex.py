"""An FM-index over integer symbols: suffix array by prefix doubling, Burrows-Wheeler transform in a bit-packed wavelet matrix, backward search.

All searches run for many patterns side by side in numpy.  Patterns are stretches of the indexed text itself, of at most ``reach`` symbols and without
the separator 0.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes in the order of their first ``reach`` symbols at least."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    values = text[order]
    rank[order] = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])]) + 1
    span = 1
    while span < reach and rank.max() < n:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:]
        key = rank * (n + 1) + after
        order = np.argsort(key)
        values = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])]) + 1
        span *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, reach: int):
        """text: symbols from 0 (separator) up to sigma - 1."""
        self.text = text
        sigma = int(text.max(initial=0)) + 1
        order = suffix_array(text, reach)
        transform = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        n = len(text)
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bits = (transform >> level & 1).astype(bool)
            packed = np.zeros((n >> 6) + 1, np.uint64)
            packed.view(np.uint8)[: (n + 7) >> 3] = np.packbits(bits, bitorder="little")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(n - bits.sum()))
            transform = np.concatenate([transform[~bits], transform[bits]])
        symbols = np.arange(sigma)
        self.origin = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the transform ends up among the rows of ``symbol`` in the lowest level."""
        for k in range(self.levels):
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def drop(self, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Backward search from text[end] towards text[stop]: the position where the stretch up to ``end`` occurs once only, or stop - 1 if it never does."""
        symbol = self.text[end]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        at, result, lane = end.copy(), stop - 1, np.arange(len(end))
        while len(lane):
            once = hi - lo < 2
            result[lane[once]] = at[once]
            on = ~once & (at > stop)
            lane, at, stop, lo, hi = lane[on], at[on] - 1, stop[on], lo[on], hi[on]
            if not len(lane):
                break
            symbol = self.text[at]
            both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.tile(self.origin[symbol] - self.first[symbol], 2)
            lo, hi = both[: len(lane)], both[len(lane) :]
        return result

    def repeated_windows(self, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
        """For stretches whose windows start at first..last (at most 64 each): a bit for each window that occurs twice or more in the text."""
        a, b, lane = first.copy(), last.copy(), np.arange(len(first))
        mask = np.zeros(len(first), np.uint64)

        def mark(which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            n = (hi - lo + 1).astype(np.uint64)
            ones = np.where(n >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))
            mask[which] |= ones << (lo - first[which]).astype(np.uint64)

        while len(lane):
            # from the right: everything up to the drop is repeated
            p = self.drop(b + window - 1, a)
            found = p < b
            mark(lane[found], np.maximum(a, p + 1)[found], b[found])
            b = np.minimum(p, b - 1)
            on = a <= b
            lane, a, b = lane[on], a[on], b[on]
            # from the left: a stretch that occurs once rules out all windows around it
            p = self.drop(a + window - 1, a)
            whole = p < a
            mark(lane[whole], a[whole], a[whole])
            a = np.where(whole, a + 1, p + 1)
            on = a <= b
            lane, a, b = lane[on], a[on], b[on]
        return mask
