"""Words as 64-bit hashes and shingle sets of whole texts; the hashes are the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a process remembers the hash of; it forgets all when that many are reached.
CACHE_WORDS = 200_000
_cache: dict[bytes, int] = {}

_rng = np.random.default_rng(7)
#: Odd multipliers of a shingle's words, by place.
_MULTIPLIERS = _rng.integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word."""
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    get, out = _cache.get, np.empty(len(words), dtype=np.uint64)
    for at in range(0, len(words), 100_000):
        found = [get(w) for w in words[at : at + 100_000]]
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    found[i] = xxhash.xxh3_64_intdigest(w := words[at + i])
                    if len(_cache) <= CACHE_WORDS:
                        _cache[w] = found[i]
        out[at : at + len(found)] = found
    return out


def sequence_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values."""
    count = len(values) - length + 1
    total = np.full(max(count, 0), length, dtype=np.uint64)
    for i in range(length):
        total = mixed(total + values[i : i + count] * _MULTIPLIERS[i % 64]) if i % 8 == 7 else total + values[i : i + count] * _MULTIPLIERS[i % 64]
    return mixed(total)


def shingle_set(text: bytes | None, length: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text, A-Z lower-cased; fewer words than ``length`` are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(sequence_hashes(word_hashes(words), min(length, len(words))))


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    found = xxhash.xxh3_128_intdigest(values.tobytes())
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return signed(found >> 64), signed(found & ((1 << 64) - 1))
