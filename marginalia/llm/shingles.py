"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes, computed over the UTF-8 bytes with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A text with fewer words than the width
has its whole word sequence as its only shingle; a null text or one without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


class Shingler:
    def __init__(self, width: int) -> None:
        self.width = width
        self.factors = mix(np.arange(11, 11 + width, dtype=np.uint64)) | _U(1)
        self._powers(CHUNK + 1)

    def _powers(self, n: int) -> None:
        up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def sets(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Each text's distinct shingle hashes in ascending order."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(b) > CHUNK:
                out += self._chunk(held)
                held, size = [], 0
            held.append(b)
            size += len(b) + 1
        return out + (self._chunk(held) if held else [])

    def _chunk(self, blobs: list[bytes]) -> list[np.ndarray]:
        a = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
        n = len(a)
        if n > len(self.up):
            self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[a] * self.up[:n], out=sums[1:])
        blank = _BLANK[a]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            change = np.concatenate([[0], change])
        starts, ends = change[::2], change[1::2]  # the last byte is blank, so they pair up
        words = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        offsets = np.cumsum([0] + [len(b) + 1 for b in blobs])
        bounds = np.searchsorted(starts, offsets).tolist()
        w = self.width
        if len(words) >= w:
            rolled = words[: len(words) - w + 1] * self.factors[0]
            for i in range(1, w):
                rolled = rolled + words[i : len(words) - w + 1 + i] * self.factors[i]
            rolled = mix(rolled)
        out = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s >= w:
                h = np.sort(rolled[s : e - w + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif e > s:
                short = (words[s:e] * self.factors[: e - s]).sum(dtype=np.uint64, keepdims=True) + _U(e - s)
                out.append(mix(short ^ _U(0x5851F42D4C957F2D)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set; two of n sets share one by chance with odds of about n*n/2**65."""
    total = mix(hashes).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * _U(3) + _U(len(hashes))).view(np.int64)[0])


def second_fingerprint(hashes: np.ndarray) -> int:
    """Another 64 bits of the set's name, drawn independently of the first."""
    total = mix(hashes ^ _U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * _U(5) + _U(len(hashes))).view(np.int64)[0])


class Naming:
    """64-bit names of sets, unique among sets that differ in their 128 bits.

    ``renamed`` gives other names to the few sets whose first 64 bits another set has too, by both halves. ``bits`` may
    shorten the first half, which only tests do, to meet such sets.
    """

    def __init__(self, bits: int = 64, renamed: dict[tuple[int, int], int] | None = None) -> None:
        self.mask = (1 << bits) - 1
        self.renamed = renamed or {}
        self.shared = {first for first, _ in self.renamed}

    def first(self, hashes: np.ndarray) -> int:
        name = fingerprint(hashes)
        return name if self.mask == 2**64 - 1 else name & self.mask

    def __call__(self, hashes: np.ndarray) -> int:
        name = self.first(hashes)
        return self.renamed[name, second_fingerprint(hashes)] if name in self.shared else name
