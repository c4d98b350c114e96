"""Hashed word shingles of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from paperlode.llm.common import mix64, utf8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2^64, at least n of them."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = np.ones(max(n, 1 << 21), np.uint64)
            held[1:] = np.uint64(base)
            np.multiply.accumulate(held, out=held)
        _powers[base] = held
    return held


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (run of bytes other than white space, A-Z lower-cased) and the text it is in."""
    with np.errstate(over="ignore"):
        low = _LOWER[raw]
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = ~_SPACE[raw]
        starts_at = np.zeros(len(raw) + 1, bool)
        starts_at[offsets[:-1]] = True  # a word never goes on in the next text
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | starts_at[:-1]))
        ends_at = np.append(starts_at[1:-1], True)[: len(raw)]
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | ends_at)) + 1
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix64(low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw))[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * _power(_INVERSE, len(raw) + 1)[starts]
        h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    return sets_of(*utf8(column), words)


def sets_of(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than that are one shingle, none are none."""
    n_texts = len(offsets) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * n_texts
    h, owner = word_hashes(raw, offsets)
    counts = np.bincount(owner, minlength=n_texts)
    factors = mix64(np.arange(1, words + 2, dtype=np.uint64) * np.uint64(_BASE))
    with np.errstate(over="ignore"):
        padded = np.concatenate([h, np.zeros(words, np.uint64)])
        acc = np.zeros(len(h), np.uint64)
        for k in range(words):
            acc += padded[k : k + len(h)] * factors[k]
        full = mix64(acc + factors[words] * np.uint64(words))
        out, at = [], 0
        for n in counts.tolist():
            if n >= words:
                out.append(np.unique(full[at : at + n - words + 1]))
            elif n:
                out.append(mix64(np.array([np.sum(h[at : at + n] * factors[:n], dtype=np.uint64) + factors[words] * np.uint64(n)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out
