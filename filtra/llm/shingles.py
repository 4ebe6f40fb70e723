"""Word shingles as 64-bit hashes, computed in numpy inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WIDTH = 5
_U = np.uint64
_MULT = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                              0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word. None is kept: hashing a word again costs less than looking it up
    among very many, and a Python worker outlives the stage."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))


def lower_words(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than WIDTH make one shingle, none make none."""
    words = lower_words(text)
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=_U)
    if n < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=_U)
    h = word_hashes(words)
    s = np.zeros(n - WIDTH + 1, dtype=_U)
    for i, m in enumerate(_MULT):
        s += h[i:n - WIDTH + 1 + i] * m
    s ^= s >> _U(31)
    s *= _MULT[1]
    s ^= s >> _U(29)
    return np.unique(s)


def set_key(shingles: np.ndarray) -> int:
    """64-bit identity of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
