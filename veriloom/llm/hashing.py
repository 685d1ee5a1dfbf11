"""Hashes of any substring of a byte buffer from prefix sums, and words and shingles built on them.

All arithmetic is modulo 2^64 on numpy arrays; no Python code runs per byte, word or shingle.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes that are neither letters nor digits
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(256, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Prefix:
    """Hashes of substrings of ``data`` (uint8): sums of byte codes times powers of an odd base."""

    def __init__(self, data: np.ndarray, seed: int = 1, base: int = 0xD1342543DE82EF95):
        n = len(data)
        with np.errstate(over="ignore"):
            self.inverse = U(pow(base, -1, 1 << 64))
            self.base = U(base)
            table = byte_table(seed)
            self.sums = np.zeros(n + 1, U)
            step = np.ones(BLOCK, U)
            np.cumprod(np.full(BLOCK - 1, self.base, U), out=step[1:])
            self.back = np.ones(BLOCK, U)
            np.cumprod(np.full(BLOCK - 1, self.inverse, U), out=self.back[1:])
            blocks = -(-n // BLOCK) + 1
            leap, leap_back = step[-1] * self.base, self.back[-1] * self.inverse
            self.leaps_back = np.ones(blocks, U)
            np.cumprod(np.full(blocks - 1, leap_back, U), out=self.leaps_back[1:])
            scale, carry = U(1), U(0)
            for at in range(0, n, BLOCK):
                part = table[data[at : at + BLOCK]]
                part *= step[: len(part)]
                part *= scale
                np.cumsum(part, out=part)
                part += carry
                self.sums[at + 1 : at + 1 + len(part)] = part
                carry, scale = part[-1], scale * leap

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Not finalized: equal substrings have equal values wherever they lie."""
        with np.errstate(over="ignore"):
            out = self.sums[ends]
            out -= self.sums[starts]
            out *= self.back[starts & (BLOCK - 1)]
            out *= self.leaps_back[starts // BLOCK]
            return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, and their bounds in it."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without the bytes of ``between``, none across a bound; and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~between[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = bounds[1:-1]
    at = inner[inner < len(data)]
    opens[at] = solid[at]
    before = inner[inner > 0] - 1
    closes[before] = solid[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shingles(word_hash: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` successive words of each text, and each text's first one.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    n = np.diff(firsts)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_first = np.zeros(len(firsts), np.int64)
    np.cumsum(counts, out=out_first[1:])
    owner = np.repeat(np.arange(len(n)), counts)
    start = np.arange(out_first[-1]) - out_first[owner] + firsts[owner]
    end = firsts[1:][owner]
    padded = np.concatenate([mix(word_hash), np.zeros(width, U)])
    with np.errstate(over="ignore"):
        out = np.zeros(len(start), U)
        for k in range(width):
            out = out * U(0x9E3779B97F4A7C15) + np.where(start + k < end, padded[start + k], U(0x5851F42D4C957F2D))
        return mix(out), out_first


def text_shingles(texts: list[str], width: int = 5, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of lower-cased texts; their words are the runs without the bytes of ``between``."""
    data, bounds = joined([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    starts, ends, firsts = words(data, bounds, between)
    return shingles(Prefix(data).hashes(starts, ends), firsts, width)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """The bounds of runs of equal neighbours."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
