"""Token ids as Arrow stream files of equal-length sequences with masks.

Each file holds record batches of two fixed-size-list columns, ``ids`` (unsigned
16-bit) and ``mask`` (bits: false where the last sequence is padded).  A memory
map of a file gives its batches without a copy, and sequence i is row
i % BATCH_ROWS of batch i // BATCH_ROWS.  Beside it lies a stream file with each
document's id, local start and length.  Documents follow each other in ascending
doc_id order: rows are dealt by ranges of doc_id and sorted there, each task
writes one pair of files under names of its own attempt, and only those of tasks
that ended well are listed in the manifest, so lost executors leave no trace.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BATCH_BYTES
from .common import exchange_count, fresh_path, library_chunks, saved, slices, smaller_batches, table

SEQUENCE = 2048
BATCH_ROWS = 64
END_ID = 1
PAD_ID = 0
MANIFEST = "part int, sequences string, documents string, n_documents long, n_sequences long, n_tokens long"


def sequence_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Takes ids as they come and writes whole batches; close() pads the last sequence."""

    def __init__(self, out, length: int, pad: int):
        self.length, self.pad = length, pad
        self.file = pa.ipc.new_stream(out, sequence_schema(length))
        self.held: list[bytes] = []
        self.n_held = self.n_sequences = 0

    def add(self, ids16: bytes) -> None:
        self.held.append(ids16)
        self.n_held += len(ids16) // 2
        if self.n_held >= self.length * BATCH_ROWS:
            self._write(self.n_held - self.n_held % (self.length * BATCH_ROWS))

    def _write(self, n: int) -> None:
        flat = np.frombuffer(b"".join(self.held), "<u2")
        rest = flat[n:]
        self.held, self.n_held = [rest.tobytes()] if len(rest) else [], len(rest)
        n_rows = -(-n // self.length)
        ids = np.full(n_rows * self.length, self.pad, np.uint16)
        ids[:n] = flat[:n]
        mask = np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_table(pa.table(lists, schema=self.file_schema), max_chunksize=BATCH_ROWS)
        self.n_sequences += n_rows

    @property
    def file_schema(self) -> pa.Schema:
        return sequence_schema(self.length)

    def close(self) -> None:
        if self.n_held:
            self._write(self.n_held)
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, uri: str):
        self.batches = list(open_stream(uri))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b, k = self.batches[i // BATCH_ROWS], i % BATCH_ROWS
        return b["ids"][k].values.to_numpy(), b["mask"][k].values.to_numpy(zero_copy_only=False)


def open_stream(uri: str) -> pa.RecordBatchStreamReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.ipc.open_stream(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def write_files(docs: DataFrame, vocabulary: str, at: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Writes the files below the URI `at`; returns their manifest, a stored table.

    A null or empty text is the end id alone; a text of any length is encoded by
    one worker, beside a batch of about BATCH_BYTES.  Rows with a null doc_id come
    first; rows that repeat a doc_id follow each other, in the order of their texts'
    hashes; other columns don't matter, and an empty table has no files.
    """
    smaller_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # rows that share a doc_id, or have none, may lie in several ranges: their texts' hashes order them
    order = ("doc_id", F.xxhash64("text"))
    dealt = rows.repartitionByRange(exchange_count(docs.sparkSession), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), library_chunks(vocabulary)
        end = np.array([end_id], "<u2").tobytes()
        fs, folder = pafs.FileSystem.from_uri(at)
        n_docs = at_token = 0
        opened = None
        for batch in batches:
            for rows in slices(batch, most=BATCH_BYTES):
                if opened is None:
                    fs.create_dir(folder)
                    names = [f"part-{part:06d}-{uuid.uuid4().hex}.{kind}.arrows" for kind in ("sequences", "documents")]
                    opened = [fs.open_output_stream(f"{folder}/{n}") for n in names]
                    sequences, index = SequenceWriter(opened[0], length, PAD_ID), pa.ipc.new_stream(opened[1], DOCUMENTS)
                sizes = []
                for ids16 in encoder.encode(rows["text"].to_pylist()):
                    sequences.add(ids16 + end)
                    sizes.append(len(ids16) // 2 + 1)
                starts = at_token + np.cumsum([0, *sizes[:-1]])
                index.write_batch(pa.record_batch([rows["doc_id"], pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCUMENTS))
                n_docs, at_token = n_docs + len(sizes), at_token + sum(sizes)
        if opened:
            sequences.close()
            index.close()
            for f in opened:
                f.close()
            yield pa.RecordBatch.from_pylist([dict(part=part, sequences=f"{at}/{names[0]}", documents=f"{at}/{names[1]}", n_documents=n_docs, n_sequences=sequences.n_sequences, n_tokens=at_token)], pa.schema([("part", pa.int32()), ("sequences", pa.string()), ("documents", pa.string()), *((n, pa.int64()) for n in ("n_documents", "n_sequences", "n_tokens"))]))

    return saved(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids (unsigned 32-bit) of each document, from the files.

    The manifest has one row for each file, so its token counts are summed on the driver.
    """
    spark = manifest.sparkSession
    files = sorted((r.part, r.sequences, r.documents, r.n_tokens) for r in manifest.collect())
    starts = accumulate((n for *_, n in files), initial=0)
    listed = [(s, d, b) for (_, s, d, _), b in zip(files, starts, strict=False)]
    names = spark.createDataFrame(listed, "sequences string, documents string, base long").repartition(max(1, min(len(listed), 10_000)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            stored = [b["ids"].flatten().to_numpy() for b in SequenceFile(row["sequences"]).batches]
            firsts = [0, *accumulate(len(x) for x in stored)]
            for index in open_stream(row["documents"]):
                ids = []
                for start, n in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist(), strict=True):
                    k, got = bisect_right(firsts, start) - 1, []
                    while n:
                        x = stored[k][start - firsts[k] : start - firsts[k] + n]
                        got.append(x)
                        start, n, k = start + len(x), n - len(x), k + 1
                    ids.append((got[0] if len(got) == 1 else np.concatenate(got)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([index["doc_id"], pa.array(index["start"].to_numpy() + row["base"]), index["n_tokens"], pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "tokens"))
    return read_documents(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
