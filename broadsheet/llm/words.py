"""Vectorised word and shingle hashes over whole batches of texts (numpy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_RNG.integers(1, 2**62)) * 2 + 1
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BLOCK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * np.uint64(pow(base, filled, 2**64))
        filled += more
    return out


_CACHE: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int, inverse: bool) -> np.ndarray:
    held = _CACHE.get((base, inverse))
    if held is None or len(held) < n:
        held = powers(pow(base, -1, 2**64) if inverse else base, max(n, BLOCK + 1))
        if len(held) <= 8 * BLOCK:
            _CACHE[base, inverse] = held
    return held[:n]


def window_hashes(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``width`` values, by differences of one running sum."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n, False), out=total[1:])
    return mixed((total[width:] - total[:-width]) * _power(base, n - width + 1, True))


class Splitter:
    """Word hashes of texts; ``separators`` are the ASCII bytes between words, A-Z count as a-z."""

    def __init__(self, separators: bytes):
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        self.code = _BYTE.copy()
        self.code[65:91] = self.code[97:123]

    def words(self, text: bytes) -> np.ndarray:
        return next(self.each([text]))

    def each(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The word hashes of each text. Short texts are hashed together in blocks, a long one by itself."""
        block: list[bytes] = []
        size = 0
        for text in texts:
            if block and size + len(text) > BLOCK:
                yield from self._block(block)
                block, size = [], 0
            block.append(text)
            size += len(text) + 1
        if block:
            yield from self._block(block)

    def places(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word of a byte buffer that ends with a separator."""
        edge = np.flatnonzero(np.diff(self.apart[buffer].view(np.int8), prepend=np.int8(1)))
        starts, ends = edge[::2], edge[1::2]
        return self.span_hashes(buffer, starts, ends), starts, ends

    def span_hashes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of given spans of a byte buffer."""
        total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.code[buffer] * _power(_STEP, len(buffer), False), out=total[1:])
        return mixed((total[ends] - total[starts]) * _power(_STEP, len(buffer), True)[starts])

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        hashes, starts, _ = self.places(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        upto = np.searchsorted(starts, np.cumsum(lengths))
        first = 0
        for last in upto.tolist():
            yield hashes[first:last]
            first = last


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` consecutive words, sorted; fewer words make one shingle, none make none."""
    n = len(words)
    return np.unique(window_hashes(words, min(width, n) or 1))


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_ALNUM = bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122 or 65 <= x <= 90))
