"""Word and shingle hashes of whole texts, computed over batches of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Multipliers of the 64-bit finaliser and the base of word hashes.
MIX_1, MIX_2, BASE = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words of ``data``.

    A word is a run of bytes other than space and 0x09-0x0D. Its hash is a
    polynomial over its bytes, taken from a running sum, then finalised.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first, end
    # The power falls with the position, so that a word's sum is divided by the
    # power at its end; base is odd, so the inverse exists modulo 2**64.
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(len(raw), BASE), out=sums[1:])
    word = (sums[end] - sums[first]) * _powers(len(raw), inverse)[first]
    return mix(word ^ (end - first).astype(np.uint64)), first, end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with fewer words, of the whole run; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = out * BASE + words[k : n - size + 1 + k]
    return mix(out ^ U64(size))
