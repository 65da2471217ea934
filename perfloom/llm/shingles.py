"""Word-shingle sets and MinHash signatures of whole texts, vectorised over batches of texts.

Words are runs of bytes other than space and 09-0D, with A-Z in lower case. A text's set holds its distinct shingles
of `width` words as 64-bit hashes; with fewer words, the whole sequence as one. Without words the set is empty.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 64, 256, _U)
_BASE = 0x9E3779B97F4A7C15 | 1
_ORDER = _RNG.integers(0, 1 << 64, 64, _U) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b & (1 << 64) - 1, _U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, in order, and the number of words of each text."""
    n = len(texts)
    text = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, n) + 1
    text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
    space = (text == 32) | ((text >= 9) & (text <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _tables(len(text) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[text] * power[: len(text)])])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    ends = np.cumsum(lengths)
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    """For each of len(h) - width + 1 places, the hash of `width` words."""
    m = len(h) - width + 1
    out = np.zeros(max(0, m), _U)
    for k in range(width):
        out += h[k : k + m] * _ORDER[k]
    return mix(out)


def sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BLOCK):
            size += len(texts[j]) + 1
            j += 1
        hashes, counts = words(texts[i:j])
        all_of = _combined(hashes, width) if len(hashes) >= width else np.zeros(0, _U)
        at = 0
        for c in counts.tolist():
            if c >= width:
                s = np.sort(all_of[at : at + c - width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif c:
                out.append(mix(_combined(hashes[at : at + c], c) + _U(c)))
            else:
                out.append(np.zeros(0, _U))
            at += c
        i = j
    return out


class MinHash:
    """Signatures of `count` 32-bit minima."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, (count, 1), np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (count, 1), np.uint32)

    def signatures(self, found: list[np.ndarray], block: int = 4096) -> np.ndarray:
        """A row for each set; that of an empty set has no meaning."""
        out = np.full((len(found), len(self.a)), 0xFFFFFFFF, np.uint32)
        i = 0
        while i < len(found):
            j, size = i, 0
            while j < len(found) and (j == i or size + len(found[j]) <= block):
                size += len(found[j])
                j += 1
            full = [k for k in range(i, j) if len(found[k])]
            if full:
                x = (np.concatenate([found[k] for k in full]) >> _U(32)).astype(np.uint32)
                if len(full) == 1:
                    for s in range(0, len(x), block):
                        np.minimum(out[full[0]], (self.a * x[s : s + block] + self.b).min(1), out=out[full[0]])
                else:
                    at = np.concatenate([[0], np.cumsum([len(found[k]) for k in full])[:-1]])
                    out[full] = np.minimum.reduceat(self.a * x + self.b, at, axis=1).T
            i = j
        return out
