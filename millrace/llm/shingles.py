"""Weighted word shingles as numbers: five-word windows, hashed, with their counts."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: np.ndarray = np.ones(1, np.uint64)
_inverse: np.ndarray = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        _powers = np.full(size, _BASE, np.uint64)
        _inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)
        _powers[0] = _inverse[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverse, out=_inverse)
    return _powers, _inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalized(text: str | None) -> str:
    """Lower case, words set apart by single blanks."""
    return " ".join((text or "").lower().split())


def text_key(norm: str) -> bytes:
    return hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def word_hashes(norm: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if not norm:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(norm.encode("utf-8", "surrogatepass"), np.uint8)
    powers, inverse = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers[: len(raw)], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def weighted_shingles(norm: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs; a shorter text is one shingle."""
    words = word_hashes(norm)
    n = len(words)
    if not n:
        return words, np.zeros(0, np.int64)
    width = min(WORDS, n)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _STEP[k]
    return np.unique(mixed(total), return_counts=True)


def probability_jaccard(a: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Exact: the sum over shared x of 1 / sum over all y of max(v(y)/v(x), w(y)/w(x))."""
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    vs, ws = v[i].astype(float), w[j].astype(float)
    only_v, only_w = float(v.sum()) - vs.sum(), float(w.sum()) - ws.sum()
    ratio = ws / vs
    order = np.argsort(ratio, kind="stable")
    low = np.concatenate([[0.0], np.cumsum(vs[order])])
    high = np.concatenate([np.cumsum(ws[order][::-1])[::-1], [0.0]])
    upto = np.searchsorted(ratio[order], ratio, side="right")
    return float((1.0 / ((only_v + low[upto]) / vs + (only_w + high[upto]) / ws)).sum())
