"""What the operators share: stored tables, text batches and vocabularies."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.stored import dropped, fresh_path, saved, shared_dir

__all__ = ["dropped", "fresh_path", "saved", "shared_dir"]

#: White space of the contracts: space and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Rows of a batch that goes to Python.
BATCH_ROWS = 1000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as it takes to be none of `taken` in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def exchange_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smaller_batches(spark: SparkSession) -> None:
    """Sets how many rows go to Python at once, if the session says nothing of it: 10,000 long texts are too many."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow; make() runs once in each task and returns what maps a batch."""
    smaller_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield from f(b)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def joined_bytes(column: pa.Array, sep: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, each followed by `sep`, and where each string begins (one more: the end)."""
    parts = [(x or "").encode() for x in column.to_pylist()]
    raw = bytes([sep]).join([*parts, b""])
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)


def little_endian(ids: list[int], code: str) -> bytes:
    return array(code, ids).tobytes()


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """strings -> ids as unsigned little-endian bytes (16 bits a token), by the tokenizers library."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)  # as it is: the string of a special token in a text is that token
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 ids doesn't fit 16 bits")

    def whole(texts: list[str]) -> list[bytes]:
        return [little_endian(e.ids, "H") for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    # what a word of letters, after a space, is to the model: as the vocabulary's pre-tokenizer has it
    table = byte_characters()
    model, forms = tok.model, (lambda w: "\u0120" + w, str.lower)
    probes = [" Ab", " cd", " \u00e9t\u00e9", " Zz"]

    def parts(word: str, form: Callable[[str], str]) -> bytes:
        return little_endian([t.id for t in model.tokenize(form(word[1:]) if word.isascii() else spelt(form(word[1:])))], "H")

    wide = {c: chr(c).encode().decode("latin-1").translate(table) for c in range(128, 256)}

    def spelt(word: str) -> str:
        return word.translate(wide)

    form = next((f for f in forms if [parts(p, f) for p in probes] == whole(probes)), None)

    def encode_many(texts: list[str]) -> list[bytes]:
        if form is None:
            return whole(texts)
        word = [t[:1] == " " and t[1:].isalpha() and max(t) <= "\u00ff" for t in texts]
        rest = iter(whole([t for t, w in zip(texts, word, strict=True) if not w]))
        return [parts(t, form) if w else next(rest) for t, w in zip(texts, word, strict=True)]

    return encode_many


def byte_characters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def library_chunks(path: str):
    """One chunk cache for each worker process, kept over its tasks."""
    from .chunks import ChunkEncoder

    return ChunkEncoder(library_encoder(path))


def widened(ids16: bytes) -> np.ndarray:
    return np.frombuffer(ids16, "<u2").astype("<u4")


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
