"""An FM-index over word numbers: backward search through wavelet ranks, sampled positions.

The text is an array of word numbers in which 0 ends a stretch. Ends are told apart by their place,
so no match runs across one and suffixes differ by the end of their stretch at the latest.
"""

from __future__ import annotations

import numpy as np

#: A position in so many, counted from the start of its stretch, is stored.
SAMPLED = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts the first few words with numpy, then doubles the depth of what is still tied.

    `text` ends in 0. Suffixes that reach an end within the compared depth are final: ends are in
    text order, and so are such suffixes.
    """
    n = len(text)
    place, bits = n.bit_length(), max(int(text.max()).bit_length(), 1)
    depth = max(1, (63 - place) // bits)
    padded = np.concatenate([text, np.zeros(depth, np.int64)])
    key, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(depth):
        word = np.where(inside, padded[j:j + n], 0)
        inside = word > 0
        key = key << bits | word
    order = np.sort(key << place | np.arange(n))
    sa = order & ((1 << place) - 1)
    key = order >> place
    begins = np.ones(n, bool)
    begins[1:] = (key[1:] != key[:-1]) | ~inside[sa[1:]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    while True:
        alone = begins & np.append(begins[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return sa
        suffix = sa[tied]
        key = rank[suffix] << place | rank[suffix + depth]
        order = np.argsort(key, kind="stable")
        sa[tied], key = suffix[order], key[order]
        differs = np.append(True, key[1:] != key[:-1])
        begins[tied] = differs
        rank[sa[tied]] = np.maximum.accumulate(np.where(differs, tied, 0))
        depth *= 2


class Wavelet:
    """Wavelet matrix: rank of a symbol, and symbol with its rank, for arrays of positions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.ones, self.zeros = [], []
        self.shifts = list(range(bits - 1, -1, -1))
        for shift in self.shifts:
            bit = (symbols >> shift & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = self.bottom(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def bottom(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros):
            one = ones[at]
            at = np.where(symbol >> shift & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.bottom(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the positions, and how often each stands before its position."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at]
            bit = ones[at + 1] > one
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + one, at - one)
        return symbol, at - self.begin[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """`text` ends in 0 and holds numbers below `symbols`."""
        bits = max(int(symbols - 1).bit_length(), 1)
        sa = suffix_array(text)
        before = np.append(0, text)[sa]
        self.before = Wavelet(before, bits)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=1 << bits)))
        start = np.zeros(len(text), np.int64)
        after_end = np.append(True, text[:-1] == 0)
        start = np.maximum.accumulate(np.where(after_end, np.arange(len(text)), 0))
        sampled = ((np.arange(len(text)) - start) % SAMPLED == 0)[sa]
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled, dtype=np.int32)])
        self.positions = sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, one a row, words from the right of each row's length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), int(self.first[-1]))
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1]):
            live = live[high[live] > low[live]]
            now = live[lengths[live] > j]
            if not len(now):
                break
            word = phrases[now, lengths[now] - 1 - j]
            low[now] = self.first[word] + self.before.rank(word, low[now])
            high[now] = self.first[word] + self.before.rank(word, high[now])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the nearest stored position."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled[at[live]]
            done = live[known]
            out[done] = self.positions[self.sample_rank[at[done]]] + steps
            live = live[~known]
            word, rank = self.before.access(at[live])
            at[live] = self.first[word] + rank
            steps += 1
        return out
