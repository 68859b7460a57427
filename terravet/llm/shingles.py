"""Hashes of words and word shingles, vectorised over many texts at once."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * BASE)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (size - 1).bit_length()))[:size]


INVERSE = U(pow(int(BASE), -1, 1 << 64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text); A-Z in lower case, words end at ASCII white space."""
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    low, high = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(byte_values()[data] * powers(int(BASE), len(data)), dtype=U, out=total[1:])
    hashed = mix((total[high] - total[low]) * powers(int(INVERSE), len(data))[low] + (high - low).astype(U))
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return hashed, np.searchsorted(first, low, "right") - 1


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, no words give none."""
    hashed, owner = words(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(len(hashed), U)
    for i in range(width):
        rolled[:len(hashed) - i] = rolled[:len(hashed) - i] * BASE + hashed[i:]
    made = mix(rolled + U(width))
    out = []
    for j in range(len(texts)):
        n = int(count[j])
        if n >= width:
            out.append(np.unique(made[first[j]:first[j + 1] - width + 1]))
        elif n:
            whole = U(0)
            for h in hashed[first[j]:first[j + 1]]:
                whole = U((int(whole) * int(BASE) + int(h)) & (1 << 64) - 1)
            out.append(mix(np.array([whole + U(n)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * size + 1, dtype=U) * BASE)
    return seeds[:size], seeds[size:] | U(1)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures, one row for each set; a coordinate is made part of its value.  Empty sets give zeros."""
    out = np.zeros((len(sets), size), U)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if filled:
        every = np.concatenate([sets[i] for i in filled])
        starts = np.cumsum([0, *(len(sets[i]) for i in filled)])[:-1]
        salt, factor = permutations(size)
        for j in range(size):
            out[filled, j] = mix(np.minimum.reduceat((every ^ salt[j]) * factor[j], starts) + U(j))
    return out.view(np.int64)
