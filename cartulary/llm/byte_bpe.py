"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary.

An element is a text with its matches of the splitting pattern and their tokens.
A text is halved until it is short; the leaves are split and encoded, and ``joined``
makes the element of two neighbours: it splits a window around the boundary anew
and widens it until the matches outside provably stay.  What a match is depends
on no more than the characters from its start to the first one of the second match
after it: a run ends at the next character of another kind, white space is given
back one character before that, and an apostrophe looks two characters ahead.  So
all matches of the left text but its last two stay, and so do those of the right
text from the first place on where the window, with two matches more, has a border
too.

The tokens of one long match are a monoid in the same way.  ``join`` encodes a
window around the boundary anew, and widens it until its outer tokens stay next to
the tokens outside.  Two adjacent tokens stay next to each other if their own bytes,
encoded alone, give just these two; a sequence all of whose adjacent pairs do is
the encoding of its bytes, so nothing outside the window can change.

Decoding concatenates the bytes of the tokens up a tree of halves.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BATCH_BYTES
from .common import little_endian, map_batches, slices, table, widened

#: Characters of a leaf, bytes that are merged directly, tokens that are decoded at once.
LEAF_CHARS = 2048
LEAF_BYTES = 16
LEAF_TOKENS = 1024
#: Bytes that one generation of remembered matches takes about, bytes of the longest one, and pairs of tokens remembered.
REMEMBERED_BYTES = 24 << 20
LONGEST_REMEMBERED = 64
REMEMBERED_PAIRS = 1 << 16
#: Matches at the end of a text that what follows it may change.
OPEN_MATCHES = 2


class Remembered(dict):
    """Matches to their ids, as 16-bit bytes; what isn't there is encoded.  Two generations, so memory is bounded."""

    def __init__(self, encode, limit: int = REMEMBERED_BYTES):
        super().__init__()
        self.encode, self.limit, self.held, self.old = encode, limit, 0, {}

    def __missing__(self, match: str) -> bytes:
        if (ids := self.old.get(match)) is None:
            ids = little_endian(self.encode(match.encode()), "H")
        if len(match) <= LONGEST_REMEMBERED:
            if self.held > self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[match] = ids
            self.held += 200 + 4 * len(match)
        return ids


@dataclass(frozen=True)
class Encoded:
    """A text's matches in order, and the ids of each."""

    matches: list[str]
    ids: list[bytes]


class ByteBpe:
    """ranks: the bytes of each token and its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        # white space is the Unicode property, as in the tokenizer's own pattern engine
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.known = Remembered(self.match)

    def merge(self, raw: bytes) -> list[int]:
        """Leaf: adjacent parts with the lowest rank become one, the leftmost first, as long as any do."""
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2]) for i in range(len(raw) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def stays(self, a: int, b: int) -> bool:
        if (s := self.known_pairs.get((a, b))) is None:
            if len(self.known_pairs) >= REMEMBERED_PAIRS:
                self.known_pairs.clear()
            s = self.known_pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return s

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of one match from those of its two parts."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(width, len(right))
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.stays(left[a - 1], window[0])) and (b == len(right) or self.stays(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES:
            return self.merge(raw)
        mid = len(raw) // 2
        return self.join(self.tree(raw[:mid]), self.tree(raw[mid:]))

    def match(self, raw: bytes) -> list[int]:
        """One match of the pattern; one that is a token as a whole is that token."""
        return [i] if (i := self.ranks.get(raw)) is not None else self.tree(raw)

    def encoded(self, text: str, leaf: int = LEAF_CHARS) -> Encoded:
        if len(text) <= leaf:
            matches = self.find(text)
            return Encoded(matches, list(map(self.known.__getitem__, matches)))
        mid = len(text) // 2
        return self.joined(self.encoded(text[:mid], leaf), self.encoded(text[mid:], leaf))

    def joined(self, left: Encoded, right: Encoded) -> Encoded:
        """The element of the concatenated texts."""
        if not left.matches or not right.matches:
            return right if right.matches else left
        a = max(0, len(left.matches) - OPEN_MATCHES)
        tail = left.matches[a:]
        border, width = sum(map(len, tail)), OPEN_MATCHES
        while True:
            b = min(width, len(right.matches))
            new = self.find("".join(tail + right.matches[:b]))
            ends = list(accumulate(map(len, new)))
            old = [border + n for n in accumulate(map(len, right.matches[:b]))]
            settled = len(new) if b == len(right.matches) else len(new) - OPEN_MATCHES
            for k in range(bisect_left(ends, border), settled):
                j = bisect_left(old, ends[k], hi=b - 1)
                if ends[k] == border or old[j] == ends[k]:
                    rest = 0 if ends[k] == border else j + 1
                    ids = [self._ids(new[i], ends[i], border, left, right) for i in range(k + 1)]
                    return Encoded(left.matches[:a] + new[: k + 1] + right.matches[rest:], left.ids[:a] + ids + right.ids[rest:])
            width *= 2

    def _ids(self, match: str, end: int, border: int, left: Encoded, right: Encoded) -> bytes:
        """A match of the window; a long one that is the last of the left text and the first of the right joins their tokens."""
        x, y = left.matches[-1], right.matches[0]
        if len(match) > LEAF_BYTES and end == border + len(y) and len(match) == len(x) + len(y) and match.encode() not in self.ranks:
            return little_endian(self.join(*(np.frombuffer(t, "<u2").tolist() for t in (left.ids[-1], right.ids[0]))), "H")
        return self.known[match]

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned little-endian 16-bit numbers."""
        return b"".join(self.encoded(text).ids)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=1)
def loaded(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 ids doesn't fit 16 bits")
    return ByteBpe(ranks, pattern)


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode_documents(docs: DataFrame, ranks: str, pattern: str, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit, little-endian) of each row's whole text; `decode` adds the decoded bytes.

    A null or empty text has no ids; a text of any length is halved, so its cost
    grows with its length and a worker holds one text at a time beside a batch of
    about BATCH_BYTES.  Null doc_ids and repeated rows stay as they are, other
    columns don't matter, and an empty table gives an empty result.
    """

    def make():
        bpe = loaded(ranks, pattern)

        def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, most=BATCH_BYTES):
                ids = [widened(bpe.encode(t or "")) for t in part["text"].to_pylist()]
                columns = [part["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

        return encode

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, ENCODED + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of encode_documents with their decoded bytes."""

    def make():
        bpe = loaded(ranks, pattern)

        def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "ids"):
                raw = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

        return decode

    return map_batches(encoded.select("doc_id", "n_tokens", "ids"), make, ENCODED + ", decoded binary")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    out = encode_documents(table(spark, sf_dir, "documents"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
