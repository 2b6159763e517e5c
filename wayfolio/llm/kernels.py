"""Array work on the texts of one Arrow batch: words, their hashes, shingles. No text becomes a Python object."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Words are hashed in stretches of so many, so that the arrays stay in cache.
STRETCH = 1 << 15
#: Words of more bytes than this are digested one by one.
LONG_WORD = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins in them (one entry more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words, split at ASCII white space, and per text where its words begin among them."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    before[inner] = True
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, space[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased; equal in every batch and on every machine.

    Eight bytes at a time go through a full mix each, so no family of words falls together; long words are digested whole.
    """
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=low[:len(raw)])
    eight = np.ndarray((len(raw) + 1,), "<u8", low, strides=(1,))
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), STRETCH):
        size, begin = sizes[a:a + STRETCH], starts[a:a + STRETCH]
        value = mix(size.astype(np.uint64))
        left = np.flatnonzero(size <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            left = left[size[left] > k]
            if not len(left):
                break
            rest = np.minimum(size[left] - k, 8).astype(np.uint64)
            part = eight[begin[left] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest))
            value[left] = mix(value[left] + part * _ODD)
        for i in np.flatnonzero(size > LONG_WORD):
            digest = hashlib.blake2b(low[begin[i]:begin[i] + size[i]], digest_size=8).digest()
            value[i] = int.from_bytes(digest, "little")
        out[a:a + STRETCH] = value
    return out


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and per text where its shingles begin.

    A text of fewer words, but not none, has one shingle: all its words, in order.
    """
    counts = np.diff(per_text)
    n = np.where(counts >= size, counts - (size - 1), np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], np.uint64)
    full = counts >= size
    if full.any():
        rolled = words[:len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = mix(rolled) + words[k:len(words) - size + 1 + k]
        rolled = mix(rolled)
        inside = np.repeat(np.arange(len(n)), n)
        at = np.arange(bounds[-1]) - bounds[inside] + per_text[inside]
        keep = full[inside]
        out[keep] = rolled[at[keep]]
    for t in np.flatnonzero(~full & (counts > 0)):
        value = np.array([counts[t]], np.uint64)
        for w in words[per_text[t]:per_text[t + 1]]:
            value = mix(value) + w
        out[bounds[t]] = mix(value)[0]
    return out, bounds


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(column)
    starts, ends, per_text = word_bounds(raw, offsets)
    hashes, bounds = shingle_hashes(word_hashes(raw, starts, ends), per_text, size)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.sort(hashes[a:b])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
