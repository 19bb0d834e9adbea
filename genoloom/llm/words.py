"""Vectorised words and hashes over the raw bytes of an Arrow string column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Multiplier of the rolling hash, odd; its inverse modulo 2^64 undoes positions.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one pass of the kernels takes at most, unless one text alone is longer.
PASS_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=4)
def byte_values(lower: bool, seed: int) -> np.ndarray:
    """A random 64-bit value per byte; with lower, A-Z get those of a-z."""
    v = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
    if lower:
        v[65:91] = v[97:123]
    return v


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PASS_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def slices(lengths: np.ndarray, limit: int = PASS_BYTES):
    """Ranges of consecutive texts of at most limit bytes together, or one text."""
    a = 0
    ends = np.cumsum(lengths)
    while a < len(lengths):
        start = ends[a] - lengths[a]
        b = max(a + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield a, b
        a = b


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column end to end, and n + 1 offsets; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of some texts: start and end byte, hash, and for each text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_texts + 1

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray) -> Words:
    """Maximal runs of word bytes in texts data[offsets[i]:offsets[i+1]]; words never cross texts."""
    n = len(data)
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)  # where a new text begins
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers(BASE, n), out=total[1:])
        h = (total[end] - total[start]) * powers(INVERSE, n + 1)[start]
        h += (end - start).astype(np.uint64)
        mix(h)
    return Words(start, end, h, np.searchsorted(start, offsets))


def windows(w: Words, offsets: tuple[int, ...], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word indices) of the windows of span words inside one text, and their hashes of the words at the offsets."""
    per = np.maximum(np.diff(w.first) - span + 1, 0)
    at = np.arange(per.sum()) + np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for o in offsets:
            h = h * np.uint64(BASE) + w.hash[at + o]
        mix(h)
    return at, h
