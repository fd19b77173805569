"""Words of many texts at once, as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import IS_SPACE, LOWER, mix64

#: Spans over so many bytes are hashed one by one.
LONG_SPAN = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes.

    Eight bytes at a time go through a mixing bijection, so spans of up to eight
    bytes of one length never share a hash, and longer ones share it as random
    numbers do; no arithmetic structure of the bytes carries over to the hash.
    """
    sizes = (ends - starts).astype(np.int64)
    h = mix64(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x8CB92BA72F3D8DD7))
    view = eights(data)
    rows, at = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN)), 0
    while len(rows):
        left = sizes[rows] - at
        part = view[starts[rows] + at] & _MASKS[np.minimum(left, 8)]
        h[rows] = mix64(h[rows] ^ part) + np.uint64(0x9FB21C651E98DF25)
        rows, at = rows[left > 8], at + 8
    for k in np.flatnonzero(sizes > LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of `data` at `starts` and of `other` at `others`, of `sizes` bytes both, hold the same bytes."""
    same = np.ones(len(starts), bool)
    one, two = eights(data), eights(other)
    rows, at = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN)), 0
    while len(rows):
        left = sizes[rows] - at
        mask = _MASKS[np.minimum(left, 8)]
        same[rows] &= (one[starts[rows] + at] & mask) == (two[others[rows] + at] & mask)
        rows, at = rows[left > 8], at + 8
    for k in np.flatnonzero(sizes > LONG_SPAN).tolist():
        same[k] = np.array_equal(data[starts[k] : starts[k] + sizes[k]], other[others[k] : others[k] + sizes[k]])
    return same


@dataclass
class Words:
    """hashes of all words in order; those of text i are hashes[bounds[i]:bounds[i + 1]]."""

    hashes: np.ndarray
    bounds: np.ndarray
    #: bytes of the words, of each text
    n_bytes: np.ndarray


def words_of(column: pa.Array, lower: bool) -> Words:
    """Words are runs of bytes other than white space; `lower` lower-cases A-Z first."""
    parts = [(x or "").encode() for x in column.to_pylist()]
    raw = b" ".join([b"", *parts, b""])
    data = np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8)
    begins = 1 + np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)  # of the texts
    space = IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # the data starts and ends with a space
    starts, ends = edges[::2], edges[1::2]
    hashes = span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, begins)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    return Words(hashes, bounds, np.diff(sizes[bounds]))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words; at text borders runs lap over and are not to be used."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, width):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return h
