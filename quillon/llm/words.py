"""Words, n-gram hashes and MinHash symbols of whole texts, computed batch-wise with numpy.

*Words* are the maximal runs of letters and digits of the lower-cased text. A null text has no words.
All hashes are 64 bits wide and the same on every machine and in every process.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """Word to hash, remembered up to a bound so that a worker's memory stays flat."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd_constants(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return x | np.uint64(1)


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in one array, and the offsets at which each text's words begin (one more than texts)."""
    get, find = _HASHES.__getitem__, WORD.findall
    parts, ends = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        found = find(t.lower()) if t else ()
        parts.extend(found)
        ends[i + 1] = len(parts)
    return np.fromiter(map(get, parts), dtype=np.uint64, count=len(parts)), ends


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; those that cross a text's end are for the caller to leave out."""
    if len(w) < n:
        return np.zeros(0, dtype=np.uint64)
    k = odd_constants(n, n)
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for j in range(n):
        h += w[j : len(w) - n + 1 + j] * k[j]
        h = mix(h) if j % 4 == 3 else h
    return mix(h)


def text_key(w: np.ndarray) -> bytes:
    """128-bit key of a sequence of words: equal for texts whose words are the same in the same order."""
    return xxhash.xxh3_128_digest(w.tobytes())


def key_of(ws: Sequence[str]) -> bytes:
    """text_key of words as strings."""
    return text_key(np.fromiter(map(_HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws)))


def minhash(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash symbols (uint32) of each run of shingle hashes; starts: where each non-empty run begins."""
    a, b = odd_constants(11, n), odd_constants(13, n)
    out = np.empty((len(starts), n), dtype=np.uint32)
    for j in range(n):
        v = ((h * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def likeness(a: Sequence[str], b: Sequence[str], n: int = 3) -> float:
    """Distinct n-word runs that both share, divided by the distinct ones of both together; 0 without any."""
    x = set(zip(*(a[i:] for i in range(n))))
    y = set(zip(*(b[i:] for i in range(n))))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def bounded_edit_distance(a: Sequence, b: Sequence, most: int) -> int | None:
    """Least insertions, deletions and substitutions that turn a into b, or None when over `most`.

    Furthest-reaching diagonals: time in proportion to `most` squared plus the matching runs, not to the product of lengths.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reach: dict[int, int] = {}
    for d in range(most + 1):
        now: dict[int, int] = {}
        for k in range(-d, d + 1):
            i = 0 if d == 0 else max(reach.get(k - 1, -2), reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1)
            if d and k == -d:
                i = reach.get(k + 1, -2) + 1
            if i < 0 or i > n or i + k < 0 or i + k > m:
                if i > n:
                    i = n
                if i < 0 or i + k < 0 or i + k > m:
                    continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            now[k] = i
            if i >= n and i + k >= m:
                return d
        reach = now
    return None
