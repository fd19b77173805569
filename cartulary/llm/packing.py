"""Best-fit packing of token sequences, mended by swap-based local search.

``pieces`` tokenises documents and cuts those that are longer than a sequence.
``placements`` deals the pieces that don't fill a sequence alone over shards of
a stated expected size, packs each shard best-fit decreasing, and then exchanges
pieces between underfull bins (move one, one for one, two for one) as long as
the sum of squared fills grows; bins that become empty go away.  The pieces of
bins that stay underfull are dealt over shards once more.  Work and memory of a
shard are bounded by its size, whatever the input; a hot source or a group
of copies is spread over shards by the hash of its ids and of the row's own
number, so no shard takes more than its share.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BATCH_BYTES
from .common import free_name, library_chunks, map_batches, saved, slices, widened

SEQUENCE = 2048
END_ID = 0
#: Expected pieces of a shard, and how full a bin must be not to be packed again.
SHARD_PIECES = 2048
FULL_ENOUGH = 0.99

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 32-bit, little-endian) of each piece.

    A null or empty text is the end id alone; a text of any length is encoded by
    one worker, beside a batch of about BATCH_BYTES.  A null doc_id is kept as it is,
    and repeated rows give their pieces each.  Only texts longer than a sequence are
    cut; the first piece then takes the remainder, the others are full.
    """

    def make():
        encoder = library_chunks(vocabulary)

        def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, most=BATCH_BYTES):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids16 in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"].to_pylist()), strict=True):
                    ids = np.append(widened(ids16), np.uint32(end_id)).astype("<u4")
                    ends = list(range((len(ids) - 1) % sequence + 1, len(ids) + 1, sequence))
                    for k, end in enumerate(ends):
                        start = ends[k - 1] if k else 0
                        for column, x in zip(rows, (doc, k, start, end - start, ids[start:end].tobytes()), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

        return cut

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # of open bins, by room
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if (k := bisect_left(room, (n, -1))) < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
            left -= n
        else:
            b, left = len(bins), size - n
            bins.append([i])
        if left:
            insort(room, (left, b))
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Exchanges between all underfull bins that raise the sum of squared fills.

    Every step makes the fuller of two bins fuller still, by moving a piece into
    it, by taking a longer piece for a shorter one, or by taking two pieces for
    one or one for two; so the emptier one drains and goes away once it is empty.
    The sum of squares grows with each step, so the search ends; it ends when no
    pair of bins gains.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    order = sorted((k for k in range(len(bins)) if fill[k] < size), key=lambda k: (fill[k], k))
    state = [0] * len(bins)  # grows as a bin changes: a pair is tried again only then
    tried: dict[tuple[int, int], tuple[int, int]] = {}
    kept: dict[int, Sums] = {}

    def sums(k: int) -> Sums:
        if k not in kept:
            kept[k] = Sums.of([(int(lengths[i]), i) for i in bins[k]])
        return kept[k]

    changed = True
    while changed:
        changed = False
        for poor in order:
            for rich in reversed(order):
                if rich == poor or not bins[poor] or not bins[rich] or fill[rich] < fill[poor]:
                    continue
                room = size - fill[rich]
                if not room or tried.get((poor, rich)) == (state[poor], state[rich]):
                    continue
                tried[poor, rich] = state[poor], state[rich]
                gain, moved, back = _best_step(sums(poor), sums(rich), room)
                if gain:
                    bins[poor] = [x for x in bins[poor] if x not in moved] + list(back)
                    bins[rich] = [x for x in bins[rich] if x not in back] + list(moved)
                    fill[poor], fill[rich] = fill[poor] - gain, fill[rich] + gain
                    state[poor], state[rich] = state[poor] + 1, state[rich] + 1
                    kept.pop(poor), kept.pop(rich)
                    changed = True
        order = sorted((k for k in order if bins[k] and fill[k] < size), key=lambda k: (fill[k], k))
    return [b for b in bins if b]


@dataclass(frozen=True)
class Sums:
    """Of a bin: the sorted different lengths of one piece and of two, and pieces that have them.

    Pieces of one length can stand for each other.  A bin of 2,048 has at most 63
    different lengths, so there are at most 2,047 sums of two.
    """

    ones: list[int]
    one: list[tuple[int, ...]]
    twos: list[int]
    two: list[tuple[int, ...]]

    @classmethod
    def of(cls, pieces: list[tuple[int, int]]) -> Sums:
        by_length: dict[int, list[int]] = {}
        for n, i in sorted(pieces):
            by_length.setdefault(n, []).append(i)
        ones = list(by_length)
        two: dict[int, tuple[int, ...]] = {}
        for k, n in enumerate(ones):
            if len(same := by_length[n]) > 1:
                two.setdefault(2 * n, (same[0], same[1]))
            for m in ones[:k]:
                two.setdefault(n + m, (same[0], by_length[m][0]))
        twos = sorted(two)
        return cls(ones, [(by_length[n][0],) for n in ones], twos, [two[n] for n in twos])


def _best_step(poor: Sums, rich: Sums, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The step that fills `room` best: (gain of the rich bin, pieces it gets, pieces it gives back)."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
    swaps = ((poor.ones, poor.one, rich.ones, rich.one), (poor.ones, poor.one, rich.twos, rich.two), (poor.twos, poor.two, rich.ones, rich.one))
    for lengths, pieces in ((poor.ones, poor.one), (poor.twos, poor.two)):
        if (k := bisect_right(lengths, room)) and lengths[k - 1] > best[0]:
            best = lengths[k - 1], pieces[k - 1], ()
    for given, give, known, back in swaps:
        for got, which in zip(given, give, strict=True):
            if best[0] == room:
                return best
            k = bisect_left(known, got - room)  # least return with which it still fits
            if k < len(known) and best[0] < (gain := got - known[k]):
                best = gain, which, back[k]
    return best


def packed(rows: DataFrame, sequence: int, shard_pieces: int) -> DataFrame:
    """row, sequence_id, offset and the bin's fill of rows (row, length), each shard packed; a stored table."""
    shards = max(1, round(rows.count() / shard_pieces))
    keyed = rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int").alias("shard"))

    def pack(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        lengths, row = (shard[c].to_numpy().astype(np.int64) for c in ("length", "row"))
        sequences, offsets, fill = (np.zeros(len(row), np.int64) for _ in range(3))
        for b in local_search(best_fit(lengths, sequence), lengths, sequence):
            offsets[b], sequences[b], fill[b] = np.cumsum(lengths[b]) - lengths[b], 2 * row[min(b)], lengths[b].sum()
        return pa.table({"row": row, "length": lengths, "sequence_id": sequences, "offset": offsets, "fill": fill})

    return saved(keyed.groupBy("shard").applyInArrow(pack, "row long, length long, sequence_id long, offset long, fill long"), "packed")


def placements(cut: DataFrame, sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The rows of `cut` (any columns with a length), which are stored, with sequence_id and offset.

    Full pieces are sequences of their own.  Bins that stay under FULL_ENOUGH of
    a sequence are emptied, and their pieces dealt over new shards once more.
    A sequence is named after one of its own pieces, so names never clash.  Columns
    of `cut` named sequence_id or offset are replaced; any others stay.
    """
    row = free_name("__row", cut.columns)
    rows = saved(cut.drop("sequence_id", "offset").withColumn(row, F.monotonically_increasing_id()), "rows")
    short = rows.filter(F.col("length") < sequence).select(F.col(row).alias("row"), F.col("length").cast("long").alias("length"))
    once = packed(short, sequence, shard_pieces)
    poor = F.col("fill") < FULL_ENOUGH * sequence
    twice = packed(once.filter(poor).select("row", "length"), sequence, shard_pieces)
    places = once.filter(~poor).unionByName(twice).select(F.col("row").alias(row), "sequence_id", "offset")
    own = F.col(row) * 2 + 1  # of a full piece
    return rows.join(places, row, "left").withColumn("sequence_id", F.coalesce("sequence_id", own)).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long"))).drop(row)


def pack_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place; `with_ids` keeps the ids, else their crc32 stays."""
    cut = pieces(docs, vocabulary, sequence, end_id)
    digest = F.crc32("ids").alias("ids_crc32")
    keep = ["doc_id", "piece", "start", "length", digest, *["ids"] * with_ids]
    return placements(cut.select(*keep), sequence)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
