"""Vectorised word splitting and rolling hashes over the bytes of whole texts.

Hashes are polynomials modulo 2**64 with odd multipliers, so a window's value
comes from two prefix sums; a finaliser spreads the bits. Two multipliers give
128 bits where equality of the hash stands for equality of the words.

Such polynomials have collisions by structure between long sequences of two
values, whatever the multiplier. They are therefore used over at most LONG
bytes or words: the hash of a longer word comes from BLAKE2b, and that of a
whole text from texts().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of a word up to which its hash is a polynomial.
LONG = 32
#: Words are maximal runs of bytes other than space and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse, at least n of them."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, m = max(n, 1 << 16), MULTIPLIERS[which]
        made = []
        for base in (m, pow(m, -1, 1 << 64)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        have = _powers[which] = (made[0], made[1])
    return have


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    p, _ = powers(which, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of [start, end) from prefix(); equal contents give equal hashes anywhere in the chunk."""
    _, inverse = powers(which, len(sums))
    return finish((sums[end] - sums[start]) * inverse[start])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and the first word of each text (one entry more than texts)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    out = windows(prefix(data.astype(U) + U(1), which), start, end, which) + (end - start).astype(U)
    for i in np.flatnonzero(end - start > LONG).tolist():
        told = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        out[i] = int.from_bytes(told[8 * which : 8 * which + 8], "little")
    return out


def texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits, as two integers, of the word sequence of each text."""
    raw = data.tobytes()
    told = [hashlib.blake2b(b" ".join(raw[a:z].split()), digest_size=16).digest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(told), dtype=np.int64).reshape(-1, 2)


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges [first, last), one after another."""
    n = last - first
    keep = n > 0
    first, n = first[keep], n[keep]
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    out = np.ones(int(n.sum()), dtype=np.int64)
    at = np.cumsum(n)[:-1]
    out[0] = first[0]
    out[at] = first[1:] - (first[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
