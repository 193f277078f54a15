"""Distinct hashes of word n-grams, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corvane.llm.common import text_ends

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pow(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n; kept up to two million."""
    if len(_powers[0]) >= n:
        return [p[:n] for p in _powers]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, U)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U))
    if n <= 2_000_000:
        _powers[:] = made
    return made


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each text, letters A-Z lower-cased; where each text's words begin, and the end."""
    n = len(texts)
    ends = text_ends(texts)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    word = ~_BLANK[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _pow(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    h = (total[stops] - total[starts]) * down[starts]
    return mix(h + (stops - starts).astype(U)), np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `size` words in a row; of all its words if it has fewer; empty without words."""
    h, at = word_hashes(texts)
    out = []
    full = np.zeros(0, U)
    if len(h) >= size:
        full = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            full = mix(full) + h[k : len(h) - size + 1 + k]
        full = mix(full)
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            x = h[a : a + 1]
            for k in range(a + 1, b):
                x = mix(x) + h[k : k + 1]
            out.append(mix(x + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
