"""Vectorised word and shingle hashing over many texts at once (numpy, 64-bit).

Words are maximal runs of bytes other than space and \\x09-\\x0D.  A word's hash is a
polynomial over its bytes modulo 2**64, taken from one prefix sum over the whole block
and mixed afterwards, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers = _inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        _powers, _inverse = np.full(size, _P), np.full(size, _PINV)
        _powers[0] = _inverse[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverse, out=_inverse)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a block of texts: ``start`` and ``end`` byte positions in ``data``,
    ``doc`` (index of the text) and, per text, the range ``first[i]:first[i+1]``."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, np.uint8)
        self.raw = data
        self.data = LOWER[data] if lower else data
        space = _SPACE[data]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(data)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def sums(self) -> np.ndarray:
        """Prefix sums of the polynomial; ``span`` turns them into hashes."""
        powers, _ = _tables(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers, out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, the same for equal bytes wherever they stand."""
        _, inverse = _tables(len(self.data))
        return mix((sums[end] - sums[start]) * inverse[np.minimum(start, len(inverse) - 1)])

    def hashes(self) -> np.ndarray:
        return self.span(self.sums(), self.start, self.end)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles, lower-cased A-Z.

    A text of fewer words, but at least one, has its whole word sequence as one shingle;
    a text without words has none.
    """
    words = Words(texts)
    n = len(words.start)
    if not n:
        return [np.zeros(0, np.uint64)] * len(texts)
    h = words.hashes()
    counts = np.diff(words.first)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = mix(acc * _MULTIPLIERS[1] + padded[k : k + n] * _MULTIPLIERS[0])
    within = np.arange(n) - words.first[words.doc]
    whole = within + size <= counts[words.doc]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        at, value = words.first[i], counts[i : i + 1].astype(np.uint64)
        for k in range(counts[i]):
            value = mix(value * _MULTIPLIERS[2] + h[at + k : at + k + 1] * _MULTIPLIERS[3])
        acc[at], whole[at] = value[0], True
    kept, doc = acc[whole], words.doc[whole]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(kept[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
