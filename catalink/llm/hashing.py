"""64-bit polynomial hashes of words and windows, worked out for whole byte arrays at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a word that crosses the border moves to the next part.
PART = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a hash over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class PrefixHash:
    """Hashes of any stretch of a byte array from sums over its prefixes."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        cls = type(self)
        if len(cls.powers) <= n:
            size = max(n + 1, 2 * len(cls.powers))
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                setattr(cls, name, np.cumprod(step, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * cls.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * type(self).inverses[start])


def word_hashes(data: bytes, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word; `blank` tells of each byte value whether it ends words."""
    whole = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(whole):
        end, size = len(whole), PART
        while at + size < len(whole):
            last = np.flatnonzero(blank[whole[at:at + size]])
            if len(last):
                end = at + int(last[-1]) + 1
                break
            size *= 2
        part = whole[at:end]
        inside = np.concatenate([[0], ~blank[part], [0]]).astype(np.int8)
        change = np.diff(inside)
        begins, ends = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
        starts.append(begins + at)
        hashes.append(PrefixHash(part).of(begins, ends))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def stretch_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the stretches of one length that begin at the given places, in order."""
    out, done = np.empty(len(starts), np.uint64), 0
    for at in range(0, len(data), PART):
        upto = int(np.searchsorted(starts, at + PART))
        if upto > done:
            own = starts[done:upto] - at
            out[done:upto] = PrefixHash(data[at:at + PART + length]).of(own, own + length)
            done = upto
    return out
