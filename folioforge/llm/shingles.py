"""Sets of word shingles as sorted 64-bit numbers, straight from Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(71)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_POWERS = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
#: Powers that a worker keeps; for more (a word longer than that) they are made anew.
_KEPT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of each number spread over all 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        made = {}
        for k, b in (("p", _BASE), ("q", _INVERSE)):
            x = np.full(n, b, dtype=np.uint64)
            x[0] = 1
            made[k] = np.multiply.accumulate(x)
        if n > _KEPT:
            return made["p"], made["q"]
        _POWERS.update(made)
    return _POWERS["p"], _POWERS["q"]


def _words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; firsts: where documents begin."""
    n = len(data)
    full = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[firsts] = True
    begin = full.copy()
    begin[1:] &= ~full[:-1] | cut[1:n]
    end = full.copy()
    end[:-1] &= ~full[1:] | cut[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    p, q = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * p[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * q[s] ^ (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)), s


def word_hashes(texts: pa.Array, block: int = 1_000_000) -> list[np.ndarray]:
    """Of each text (null: empty), its words' hashes; A-Z count as a-z. Long texts are cut at white space to bound memory."""
    col = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    parts: list[list[np.ndarray]] = [[] for _ in range(len(col))]
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[end])
        if hi - lo > block:  # one long text
            while lo < hi:
                cut = min(hi, lo + block)
                while cut < hi:
                    gaps = np.flatnonzero(_SPACE[data[lo:cut]])
                    if len(gaps):
                        cut = lo + int(gaps[-1]) + 1
                        break
                    cut = min(hi, cut + block)
                parts[at].append(_words(data[lo:cut], np.zeros(1, np.int64))[0])
                lo = cut
        elif hi > lo:
            h, s = _words(data[lo:hi], offsets[at:end] - lo)
            edges = np.searchsorted(s, offsets[at : end + 1] - lo)
            for k in range(at, end):
                parts[k].append(h[edges[k - at] : edges[k - at + 1]])
        at = end
    none = np.zeros(0, np.uint64)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else none for p in parts]


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; with fewer words than size, all words as one; none without words."""
    out = []
    for w in word_hashes(texts):
        n = len(w) - size + 1
        if n >= 1:
            s = w[:n] * _STEP[0]
            for k in range(1, size):
                s = s + w[k : k + n] * _STEP[k]
            out.append(np.unique(mix(s)))
        elif len(w):
            out.append(mix(np.array([(w * _STEP[8 : 8 + len(w)]).sum(dtype=np.uint64) + U(len(w))], dtype=np.uint64)))
        else:
            out.append(w)
    return out


def set_number(s: np.ndarray) -> int:
    """One signed number for a set; equal sets have equal ones."""
    total = int(mix(s * U(0xA24BAED4963EE407)).sum(dtype=np.uint64)) + len(s) * 0x9FB21C651E98DF25
    return int(mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0])
