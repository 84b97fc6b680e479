"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a polynomial in its bytes modulo 2**64, read off prefix sums over a
whole buffer of texts, so no Python loop runs over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**64, 256, dtype=U, endpoint=False)
_TIMES = _rng.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)
_BASE, _INVERSE = U(0x9E3779B97F4A7C15 | 5), None
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that are part of words: all but ASCII white space; ASCII letters and digits and all of non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    ALNUM[_low:_high] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, 2**bits of each."""
    inverse = U(pow(int(_BASE), -1, 2**64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(1 << bits, base, U)
        p[0] = U(1)
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value x power before each byte, and the powers' inverses."""
    power, inverse = _powers(max(16, int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    live = lengths > 0
    s, n = starts[live], lengths[live]
    if not len(s):
        return out[:0]
    at = np.cumsum(n) - n
    out[at] = np.concatenate(([s[0]], s[1:] - (s[:-1] + n[:-1] - 1)))
    return np.cumsum(out)


def word_hashes(texts: list[bytes], part_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words, and where each text's words begin (one more
    entry than texts)."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    data = _LOWER[raw]
    edge = np.diff(part_of_word[data].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    sums, inverse = prefix_sums(data)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; texts aren't told apart."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, U(k * 0xD1B54A32D192ED03 % 2**64), U)
    for j in range(k):
        out += words[j : j + n] * _TIMES[j]
    return mix(out)


def batches(texts: list[str | None], size: int = 1 << 20):
    """(first, bytes of some texts) in turn, about ``size`` bytes at once; null counts as empty."""
    part: list[bytes] = []
    held = first = 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        if part and held + len(b) > size:
            yield first, part
            part, held, first = [], 0, i
        part.append(b)
        held += len(b)
    if part:
        yield first, part
