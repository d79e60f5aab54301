"""Words of a batch of texts by numpy: runs of ASCII digits, letters (A-Z as
a-z) and any character beyond ASCII, with their bytes, texts and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
STEP = np.uint64(0xD6E8FEB86659FD93)
# lower case of A-Z for bytes of words, 0 for all others: words are runs of
# ASCII digits, letters and any character beyond ASCII
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    _c = _b + 32 if 0x41 <= _b <= 0x5A else _b
    _LOWER[_b] = _c if 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A or _c >= 0x80 else 0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """base**i and base**-i modulo 2**64 for i below a growing length."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def row(base: int) -> np.ndarray:
                steps = np.full(2 * n, base % (1 << 64), np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)
            self.up, self.down = row(_BASE), row(pow(_BASE, -1, 1 << 64))
        return self.up, self.down


class Words:
    """The words of a batch of texts: byte bounds, text numbers and hashes."""

    def __init__(self, texts: pa.Array, powers: Powers) -> None:
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.low = _LOWER[data]
        inside = self.low != 0
        n = len(data)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # texts that are not empty: words end with them
        first[heads] = inside[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.base = np.concatenate([[0], np.cumsum(self.counts)])  # of each text, its first word
        up, down = powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
