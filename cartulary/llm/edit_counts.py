"""Token counts that follow edits.

A document is cut into leaves of about LEAF_CHARS characters, only where a space
or line feed follows another character: no pre-token runs over such a place, so a
document's tokens are those of its leaves.  A segment tree holds the characters
and tokens below each node.  An edit finds its leaves by their characters and
changes their text.  If a border of what it touched isn't such a place any more,
the leaf beyond is taken in, until both borders are; these are all the tokens
that the edit can change.  Only they are encoded again, and the sums on the paths
to the root follow.

Trees are kept: ``build`` stores each document's leaves (characters and tokens)
beside its text, and ``updated`` takes stored trees with edits, encodes nothing but
what they touch, and gives trees that further edits can follow.  ``with_edits`` brings
edits from a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BATCH_BYTES, ChunkEncoder
from .common import library_chunks, map_batches, saved, slices, table

LEAF_CHARS = 256
#: start, end (exclusive) and the new text, in code points of the text as the edits before have left it.
Edit = tuple[int, int, str]

#: What the query masks: e-mail addresses and long numbers.
MASKED = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[0-9]{5,}+")


def splits(left: str, right: str) -> bool:
    """Whether no pre-token can run from left into right."""
    return not left or not right or (right[0] in " \n" and not left[-1].isspace())


def leaves_of(text: str, size: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        ends = [k for k in (text.find(" ", at + size), text.find("\n", at + size)) if k >= 0]
        k = min(ends, default=len(text))
        while k < len(text) and not splits(text[k - 1], text[k]):
            k += 1
        out.append(text[at:k])
        at = k
    return [*out, text[at:]] if at < len(text) or not out else out


class CountTree:
    """Sums of characters and tokens over a document's leaves; node 1 is the root, leaves begin at `size`."""

    def __init__(self, leaves: list[str], counts: list[int], count: Callable[[str], int]):
        self.count, self.leaves, self.size, self.encoded = count, list(leaves), 1, 0
        while self.size < len(leaves):
            self.size *= 2
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.size + list(counts) + pad
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end), and where in it."""
        k = 1
        while k < self.size:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.size, at

    def edit(self, start: int, end: int, new: str) -> None:
        if not 0 <= start <= end <= self.n_chars:
            raise IndexError("an edit outside of the text")
        first, a = self._find(start)
        last, b = self._find(end) if end > start else (first, a)
        text = self.leaves[first][:a] + new + self.leaves[last][b:]
        lo, hi = first, last
        while (k := self._beside(lo, -1)) is not None and not splits(self.leaves[k], text):
            text, lo = self.leaves[k] + text, k
        while (k := self._beside(hi, 1)) is not None and not splits(text, self.leaves[k]):
            text, hi = text + self.leaves[k], k
        self.encoded += len(text)
        self._put(lo, hi, leaves_of(text))

    def _beside(self, k: int, step: int) -> int | None:
        """The next leaf with text."""
        k += step
        while 0 <= k < len(self.leaves) and not self.leaves[k]:
            k += step
        return k if 0 <= k < len(self.leaves) else None

    def _put(self, lo: int, hi: int, parts: list[str]) -> None:
        room = hi - lo + 1
        if len(parts) > 4 * room + 4:  # a long insertion: the tree is laid out again, known counts stay
            leaves = self.leaves[:lo] + parts + self.leaves[hi + 1 :]
            counts = self.tokens[self.size :]
            again = CountTree(leaves, counts[:lo] + [self.count(p) for p in parts] + counts[hi + 1 : len(self.leaves)], self.count)
            again.encoded = self.encoded
            self.__dict__ = again.__dict__
            return
        kept = parts[: room - 1] + ["".join(parts[room - 1 :])]
        n = [sum(map(self.count, parts[k : k + 1] if k < room - 1 else parts[k:])) for k in range(len(kept))]
        touched = set()
        for k in range(room):
            leaf = lo + k
            self.leaves[leaf] = kept[k] if k < len(kept) else ""
            self.chars[self.size + leaf] = len(self.leaves[leaf])
            self.tokens[self.size + leaf] = n[k] if k < len(kept) else 0
            touched.add((self.size + leaf) // 2)
        while touched - {0}:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched if k > 1}

    def text(self) -> str:
        return "".join(self.leaves)


    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves with text: what is stored of the tree."""
        some = [k for k in range(len(self.leaves)) if self.leaves[k]]
        return [len(self.leaves[k]) for k in some], [self.tokens[self.size + k] for k in some]


def counter(encoder: ChunkEncoder) -> Callable[[str], int]:
    return lambda text: len(next(encoder.encode([text]))) // 2


def restored(text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]) -> CountTree:
    """The tree of a text from its stored leaves; nothing is encoded."""
    ends = list(accumulate(chars))
    if (ends[-1] if ends else 0) != len(text):
        raise ValueError("the leaves aren't those of the text")
    return CountTree([text[a:b] for a, b in zip([0, *ends], ends)] or [""], tokens or [0], count)


def masks(text: str) -> list[Edit]:
    """Edits that mask what MASKED finds, the last first, so that places stay as found."""
    return [(m.start(), m.end(), "<mail>" if "@" in m[0] else "<number>") for m in reversed(list(MASKED.finditer(text)))]


TREE = "doc_id long, text string, chars array<int>, tokens array<int>"
EDITS = "edits array<struct<start: int, end: int, new: string>>"
COLUMNS = ("n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded")


def build(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A stored tree for each row: doc_id, text, and the characters and tokens of its leaves.

    A null text counts as an empty one, which has no leaves; a text of any length
    is cut into leaves, which are encoded together.  Null doc_ids and repeated rows
    stay as they are; other columns don't matter; an empty table gives an empty one.
    """

    def make():
        encoder = library_chunks(vocabulary)

        def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, most=BATCH_BYTES):
                leaves = [[x for x in leaves_of(t or "") if x] for t in part["text"].to_pylist()]
                counts = (len(ids) // 2 for ids in encoder.encode([x for c in leaves for x in c]))
                tokens = [[next(counts) for _ in c] for c in leaves]
                columns = [part["doc_id"], pc.fill_null(part["text"], ""), pa.array([[len(x) for x in c] for c in leaves], pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "chars", "tokens"])

        return cut

    return saved(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, TREE), "trees")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits (doc_id, seq, start, end, new) of their document, in order of seq.

    A document's edits come together in one row, as its text does.  An edit of a
    doc_id that several rows have is made to each of them; one without a doc_id or
    a tree is made to none.
    """
    one = F.struct("seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new")
    own = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new"))).alias("edits"))
    return trees.join(own, "doc_id", "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<start: int, end: int, new: string>>")))


def with_masks(trees: DataFrame) -> DataFrame:
    """Trees with the edits that mask what MASKED finds in their texts."""

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
        for part in slices(batch):
            edits = [[dict(zip(("start", "end", "new"), e, strict=True)) for e in masks(t)] for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(edits, kind)], [*part.schema.names, "edits"])

    return map_batches(trees.select("doc_id", "text", "chars", "tokens"), lambda: find, f"{TREE}, {EDITS}")


def updated(trees: DataFrame, vocabulary: str) -> DataFrame:
    """Trees after their edits (a column as in EDITS), with the counts of COLUMNS; only what edits touch is encoded."""

    def make():
        count = counter(library_chunks(vocabulary))

        def change(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                trees, rows = [], []
                for text, chars, tokens, edits in zip(*(part[c].to_pylist() for c in ("text", "chars", "tokens", "edits")), strict=True):
                    before = sum(tokens)
                    if edits:
                        tree = restored(text, chars, tokens, count)
                        for e in edits:
                            tree.edit(e["start"], e["end"], e["new"] or "")
                        text, (chars, tokens), encoded = tree.text(), tree.kept(), tree.encoded
                    else:
                        encoded = 0
                    trees.append((text, chars, tokens))
                    rows.append((before, len(edits or ()), sum(tokens), len(text), encoded))
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                columns = [part["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*trees, strict=True), kinds, strict=True)), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "chars", "tokens", *COLUMNS])

        return change

    return map_batches(trees.select("doc_id", "text", "chars", "tokens", "edits"), make, ", ".join([TREE, *(f"{c} long" for c in COLUMNS)]))


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after its e-mail addresses and long numbers are masked."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    trees = build(table(spark, sf_dir, "documents"), vocabulary)
    return updated(with_masks(trees), vocabulary).select("doc_id", *COLUMNS)
