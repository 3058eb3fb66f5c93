"""Words of UTF-8 texts and hashes of word windows, in NumPy.

Words are maximal runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z.
"""

import numpy as np

#: Bytes hashed at a time (a longer word is hashed whole).
PIECE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _PowerTable:
    """Powers of the base and of its inverse; those for a piece are kept."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > PIECE:
            return _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        if len(self.up) <= n:
            size = min(PIECE, 2 * n) + 1
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_POWERS = _PowerTable()


class Words:
    """Words of neighbouring texts: bounds, hash and text number of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        first, last = int(offsets[0]), int(offsets[-1])
        self.low = _LOWER[data[first:last]]
        inside = np.zeros(len(self.low) + 2, bool)
        inside[1:-1] = _WORD[self.low]
        cut = np.zeros(len(self.low) + 1, bool)
        cut[offsets - first] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.text = np.searchsorted(offsets - first, self.start, "right") - 1
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            a = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, a + PIECE, "right")))
            n = int(self.end[j - 1]) - a
            up, down = _POWERS.get(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.low[a : a + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            out[i:j] = (total[self.end[i:j] - a] - total[self.start[i:j] - a]) * down[self.start[i:j] - a]
            i = j
        out ^= out >> np.uint64(29)
        out *= _STEP
        return out ^ (out >> np.uint64(32))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on, whatever texts they belong to."""
        n = len(self.hash) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for j, p in enumerate(_powers(_STEP, size)):
                out += self.hash[j : j + n] * p
            out ^= out >> np.uint64(31)
        return out

    def key(self, i: int, size: int) -> bytes:
        """The ``size`` words from word i on, joined by spaces."""
        return b" ".join(self.low[self.start[k] : self.end[k]].tobytes() for k in range(i, i + size))
