"""Whole-text token ids through a bounded cache of pieces.

No pre-token of the vocabularies used here runs over a place where a space or line
feed follows a character that isn't white space, or where one of ``. , ; : ! ?``
follows an ASCII letter or digit.  A text therefore encodes to the concatenation
of what its pieces encode to, if it is cut only there.  Natural text repeats its
pieces: the texts of a batch are cut, equal pieces are found by vectorised hashes
and then held to each other byte by byte, and the tokenizer sees only pieces whose
bytes the cache doesn't hold.  No token rests on a hash alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np

from .words import same_spans, span_hashes

#: Bytes of text that are cut at once, and bytes of the arrays of a worker's cache.
BATCH_BYTES = 3 << 20
CACHE_BYTES = 48 << 20


def _table(*parts: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[list(p)] = True
    return out


_BREAK = _table(b" \n")
_MARK = _table(b".,;:!?")
_WORD = _table(range(48, 58), range(65, 91), range(97, 123))
#: Last bytes before which no cut is allowed: ASCII white space and controls.
_LOW = _table(range(33))


def starts_of(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts that begin at `begins`; no piece holds bytes of two texts."""
    mark = np.zeros(len(data), bool)
    at = np.flatnonzero(_BREAK[data])
    at = at[at > 0]
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # white space of two or three bytes; a few other characters of these ranges are left uncut too
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
    wide |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    mark[at[~_LOW[one] & ~wide]] = True
    at = np.flatnonzero(_MARK[data])
    at = at[at > 0]
    mark[at[_WORD[data[at - 1]]]] = True
    mark[begins[begins < len(data)]] = True
    return np.flatnonzero(mark)


@dataclass(frozen=True)
class Run:
    """Known pieces, sorted by their hashes: where their bytes lie in `blob` and their ids in `ids`."""

    keys: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    blob: np.ndarray
    id_starts: np.ndarray
    id_sizes: np.ndarray
    ids: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self))

    def merged(self, other: Run) -> Run:
        both = lambda name, shift=0: np.concatenate([getattr(self, name), getattr(other, name) + np.uint32(shift)])
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        starts, id_starts = both("starts", len(self.blob)), both("id_starts", len(self.ids))
        return Run(keys[order], starts[order], both("sizes")[order], np.concatenate([self.blob, other.blob]), id_starts[order], both("id_sizes")[order], np.concatenate([self.ids, other.ids]))


class ChunkEncoder:
    """encode_many: strings to their ids, each as unsigned 16-bit little-endian bytes.

    Pieces that were met are kept in a few sorted runs of arrays, merged as they
    grow; a piece is known only if its bytes are the same.  When the arrays take more
    than `limit` bytes they are emptied, so memory stays bounded however many
    different pieces there are.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = CACHE_BYTES):
        self.encode_many, self.limit = encode_many, limit
        self.runs: list[Run] = []

    def _keep(self, run: Run) -> None:
        self.runs.append(run)
        while len(self.runs) > 1 and 2 * len(self.runs[-1].keys) > len(self.runs[-2].keys):
            last = self.runs.pop()
            self.runs[-1] = self.runs[-1].merged(last)
        if sum(r.nbytes for r in self.runs) > self.limit:
            self.runs = []

    def _some(self, texts: list[bytes]) -> Iterator[bytes]:
        raw = b"".join(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not raw:
            yield from (b"" for _ in texts)
            return
        data = np.frombuffer(raw, np.uint8)
        starts = starts_of(data, begins)
        sizes = np.diff(np.append(starts, len(data)))
        keys, example, which = np.unique(span_hashes(data, starts, starts + sizes), return_index=True, return_inverse=True)
        same = sizes == sizes[example][which]
        same[same] = same_spans(data, starts[same], data, starts[example][which][same], sizes[same])
        odd = np.flatnonzero(~same)  # pieces that share their hash with another: each counts as a piece of its own
        which[odd] = len(example) + np.arange(len(odd))
        ids, first, n_ids = self._ids(raw, data, keys, starts[np.concatenate([example, odd])], sizes[np.concatenate([example, odd])])
        size = n_ids[which]
        until = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat(first[which] - until[:-1], size) + np.arange(until[-1])].tobytes()
        cuts = (2 * until[np.searchsorted(starts, begins)]).tolist()
        yield from (out[a:b] for a, b in zip(cuts, cuts[1:]))

    def _ids(self, raw: bytes, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each piece begin and how many; keys: hashes of the first pieces, in order."""
        first, n_ids = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.int64)
        fresh = np.arange(len(starts)) < len(keys)  # no known piece has the hash
        parts, base = [], 0
        for r in self.runs:
            rows = np.flatnonzero(fresh)
            at = np.minimum(np.searchsorted(r.keys, keys[rows]), len(r.keys) - 1)
            hit = r.keys[at] == keys[rows]
            rows, at = rows[hit], at[hit]
            fresh[rows] = False
            good = r.sizes[at] == sizes[rows]
            good[good] = same_spans(data, starts[rows[good]], r.blob, r.starts[at[good]].astype(np.int64), sizes[rows[good]])
            rows, at = rows[good], at[good]
            first[rows], n_ids[rows] = base + r.id_starts[at].astype(np.int64), r.id_sizes[at]
            parts.append(r.ids)
            base += len(r.ids)
        missing = np.flatnonzero(first < 0)
        if len(missing):
            pieces = [raw[a:b] for a, b in zip(starts[missing].tolist(), (starts + sizes)[missing].tolist(), strict=True)]
            got = self.encode_many([p.decode() for p in pieces])
            n_ids[missing] = np.fromiter(map(len, got), np.int64, len(got)) // 2
            parts.append(np.frombuffer(b"".join(got), np.uint16))
            first[missing] = base + np.cumsum(n_ids[missing]) - n_ids[missing]
            if fresh.any():
                own = np.flatnonzero(fresh[missing])
                blob = np.frombuffer(b"".join([pieces[k] for k in own.tolist()]), np.uint8)
                new = missing[own]
                ends, id_ends = np.cumsum(sizes[new]), np.cumsum(n_ids[new])
                ids = np.frombuffer(b"".join([got[k] for k in own.tolist()]), np.uint16)
                u4 = lambda x: x.astype(np.uint32)
                self._keep(Run(keys[new], u4(ends - sizes[new]), u4(sizes[new]), blob, u4(id_ends - n_ids[new]), u4(n_ids[new]), ids))
        return np.concatenate(parts), first, n_ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; a null counts as an empty text."""
        some: list[bytes] = []
        size = 0
        for t in texts:
            some.append((t or "").encode())
            size += len(some[-1])
            if size >= BATCH_BYTES:
                yield from self._some(some)
                some, size = [], 0
        if some:
            yield from self._some(some)
