"""LM scoring by a probabilistic suffix tree over the bytes of a text.

Symbols are the bytes of a text's UTF-8, A-Z lower-cased, and one that ends it, so
texts of any script are scored alike.  Contexts are the last 0 to ``DEPTH`` symbols.
Those of up to one symbol are always in the tree.  A longer one is kept if it
occurs ``LEAST_COUNT`` times and its next-symbol counts diverge from what the
context without its oldest symbol predicts (a likelihood-ratio test), or if a
longer kept context needs it.  Distributions are smoothed towards the next shorter
kept context in proportion to how many different symbols follow, and each symbol
is scored by the longest kept suffix of what precedes it.

The tree grows with the corpus: any context is tested that occurs LEAST_COUNT
times, however large the corpus.  It is a table.  Runs (a context of DEPTH symbols
and the next) are counted in one shuffle; those whose contexts end with the same
two symbols are a subtree that depends on no other, so subtrees are dealt over
tasks of about TASK_RUNS runs, which decide their contexts and give each run its
log probability.  Only counts of pairs of symbols (65,536 at most) meet at the
driver.  In scoring, the HOT_RUNS runs and HOT_WORDS words that occur most go to
every task, of a fixed size; each document's other runs and words meet their
values in joins.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, dropped, map_batches, saved, slices, smaller_batches, table
from .words import words_of

SYMBOLS = 256
#: No byte of UTF-8.
END = 0xFF
DEPTH = 5
LEAST_COUNT = 4
#: A context is kept if its likelihood ratio is over so many times its degrees of freedom.
DIVERGENCE = 1.0
#: Weight of the shorter context, times the number of different symbols that follow.
SMOOTHING = 2.5
HOT_RUNS = 1 << 20
HOT_WORDS = 1 << 18
#: Runs of a task that grows subtrees, bytes of text that are cut into runs at once, keys that a task counts before it gives them out.
TASK_RUNS = 1 << 19
PIECE_BYTES = 1 << 20
TALLY_KEYS = 1 << 20
HELD_OUT_OF = 10
#: The end of a text as a word.
END_WORD = np.uint64(0x5DEECE66D1234567)
_EIGHT = np.uint64(8)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def runs_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the texts, in pieces: their codes, and the number of the text that each belongs to.

    The code of a run is its DEPTH symbols of context, the oldest highest, and then
    the next symbol; a text begins after DEPTH ends, and its own end is a symbol.
    """
    lead = bytes([END]) * DEPTH
    held: list[bytes] = []
    owner: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        raw = lead + (text or "").encode().translate(LOWER) + lead[:1]
        for at in range(DEPTH, len(raw), PIECE_BYTES):
            held.append(raw[at - DEPTH : at + PIECE_BYTES])
            owner.append(k)
            size += len(held[-1])
            if size >= PIECE_BYTES:
                yield _codes(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _codes(held, owner)


def _codes(pieces: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    code = data[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        code |= data[DEPTH - k : len(data) - k] << np.uint64(8 * k)
    sizes = np.array([len(p) for p in pieces])
    first = np.cumsum(sizes) - sizes
    keep = np.ones(len(code), bool)
    for k in range(DEPTH):  # contexts that would run over from one piece into the next
        at = first[1:] - DEPTH + k
        keep[at[(at >= 0) & (at < len(code))]] = False
    return code[keep], np.repeat(np.array(owner), sizes - DEPTH)


def suffix(code: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols."""
    return code & np.uint64((1 << 8 * n) - 1)


class Tally:
    """Counts of keys over batches, given out whenever they are many."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, row = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(row, np.concatenate([n for _, n in parts])).astype(np.int64)


RUN, WORD = 0, 1
COUNTS = "kind int, key long, n long, m long"


def counted(docs: DataFrame, training: Column) -> DataFrame:
    """kind, key, n (in training rows), m (in all rows) of the runs and words of docs, stored."""

    smaller_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {(kind, train): Tally(TALLY_KEYS) for kind in (RUN, WORD) for train in (False, True)}

        def given(kind: int, train: bool) -> pa.RecordBatch:
            keys, n = tallies[kind, train].take()
            return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n * train), pa.array(n)], ["kind", "key", "n", "m"])

        for batch in batches:
            for part in slices(batch):
                for train in (False, True):
                    texts = part.filter(pc.equal(part["training"], train))["text"]
                    if not len(texts):
                        continue
                    words = np.append(words_of(texts, lower=True).hashes, np.full(len(texts), END_WORD))
                    if tallies[WORD, train].add(words):
                        yield given(WORD, train)
                    for codes, _ in runs_of(texts.to_pylist()):
                        if tallies[RUN, train].add(codes):
                            yield given(RUN, train)
        for kind, train in tallies:
            yield given(kind, train)

    rows = docs.select("text", F.coalesce(training, F.lit(False)).alias("training"))
    return saved(rows.mapInArrow(run, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")


def pair_probabilities(pairs: list[tuple[int, int]]) -> np.ndarray:
    """Next-symbol probabilities after each symbol, from counts of pairs (code, n): the contexts of up to one symbol."""
    counts = np.zeros(SYMBOLS * SYMBOLS)
    for code, n in pairs:
        counts[code] = n
    counts = counts.reshape(SYMBOLS, SYMBOLS)
    root = counts.sum(0)
    root = (root + 0.5) / (root.sum() + 0.5 * SYMBOLS)
    weight = SMOOTHING * (counts > 0).sum(1, keepdims=True)
    total = counts.sum(1, keepdims=True)
    return np.where(total > 0, (counts + weight * root) / np.maximum(total + weight, 1e-300), root)


@dataclass
class Level:
    """Of contexts of one length that occur often enough: sorted runs with their next symbol, and the contexts."""

    runs: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    of: np.ndarray  # the context of each run
    total: np.ndarray
    kinds: np.ndarray

    @classmethod
    def count(cls, key: np.ndarray, n: np.ndarray, d: int) -> Level:
        runs, row = np.unique(suffix(key, d + 1), return_inverse=True)
        sums = np.bincount(row, n, len(runs))
        contexts, of = np.unique(runs >> _EIGHT, return_inverse=True)
        often = np.bincount(of, sums, len(contexts)) >= LEAST_COUNT
        runs, sums, of = runs[often[of]], sums[often[of]], (np.cumsum(often) - 1)[of[often[of]]]
        contexts = contexts[often]
        return cls(runs, sums, contexts, of, np.bincount(of, sums, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float))

    def smoothed(self, base: np.ndarray) -> np.ndarray:
        weight = SMOOTHING * self.kinds[self.of]
        return (self.n + weight * base) / (self.total[self.of] + weight)

    def base(self, d: int, shorter: Level | None, p: np.ndarray) -> np.ndarray:
        """What the context without its oldest symbol says of each run; of two symbols: `p` by pairs."""
        return p[self.runs & np.uint64(0xFFFF)] if shorter is None else p[np.searchsorted(shorter.runs, suffix(self.runs, d))]

    def only(self, keep: np.ndarray) -> Level:
        """With those contexts alone."""
        r = keep[self.of]
        return Level(self.runs[r], self.n[r], self.contexts[keep], (np.cumsum(keep) - 1)[self.of[r]], self.total[keep], self.kinds[keep])


def subtrees(key: np.ndarray, n: np.ndarray, pairs: np.ndarray, divergence: float = DIVERGENCE) -> list[Level]:
    """The kept contexts of each length from two on, of whole subtrees of runs with their training counts."""
    seen = n > 0
    levels, kept, shorter, p = [], [], None, pairs.ravel()
    for d in range(2, DEPTH + 1):
        level = Level.count(key[seen], n[seen], d)
        base = level.base(d, shorter, p)
        ratio = np.bincount(level.of, level.n * np.log(level.n / level.total[level.of] / base), len(level.contexts))
        kept.append(2 * ratio > divergence * level.kinds)
        levels.append(level)
        shorter, p = level, level.smoothed(base)
    for k in range(len(levels) - 1, 0, -1):  # what a kept context needs
        kept[k - 1][np.searchsorted(levels[k - 1].contexts, suffix(levels[k].contexts[kept[k]], k + 1))] = True
    return [level.only(keep) for level, keep in zip(levels, kept, strict=True)]


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are among sorted ones, and whether they are."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def log10_of(key: np.ndarray, levels: list[Level], pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each run's next symbol after its longest kept context."""
    p, shorter, known = pairs.ravel()[key & np.uint64(0xFFFF)], None, pairs.ravel()
    for d, level in enumerate(levels, 2):
        known = level.smoothed(level.base(d, shorter, known))
        shorter = level
        context, inside = found(level.contexts, suffix(key >> _EIGHT, d))
        weight = SMOOTHING * level.kinds[context[inside]]
        p[inside] *= weight / (level.total[context[inside]] + weight)  # of a symbol that never followed
        at, seen = found(level.runs, suffix(key, d + 1))
        p[inside & seen] = known[at[inside & seen]]
    return np.log10(p)


@dataclass(frozen=True)
class Model:
    """runs: key, n, m and log10 of every run that was counted; words: key, n; both stored.  tokens and kinds of words in training."""

    runs: DataFrame
    words: DataFrame
    tokens: int
    kinds: int

    @property
    def denominator(self) -> float:
        return self.tokens + 0.1 * (self.kinds + 1)


def valued(runs: DataFrame) -> DataFrame:
    """key, n, m, log10 of runs (key, n, m), stored: each subtree is grown and read in one task."""
    last_two = F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int")
    pairs = pair_probabilities([(r["pair"], r["n"]) for r in runs.filter("n > 0").groupBy(last_two.alias("pair")).agg(F.sum("n").alias("n")).collect()])
    tasks = max(1, round(runs.count() / TASK_RUNS))
    branch = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))

    def grow(group: pa.Table) -> pa.Table:
        key, n = group["key"].to_numpy().view(np.uint64), group["n"].to_numpy()
        return group.select(["key", "n", "m"]).append_column("log10", pa.array(log10_of(key, subtrees(key, n, pairs), pairs)))

    dealt = runs.select("key", "n", "m", F.pmod(F.xxhash64(branch), F.lit(tasks)).alias("task"))
    return saved(dealt.groupBy("task").applyInArrow(grow, "key long, n long, m long, log10 double"), "runs")


def learned(docs: DataFrame, training: Column) -> Model:
    """The model of the rows of docs where `training` holds, with values for the runs of all its rows."""
    counts = counted(docs, training)
    words = saved(counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n"), "words")
    runs = valued(counts.filter(F.col("kind") == RUN).select("key", "n", "m"))
    dropped(counts)
    sums = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).first()
    return Model(runs, words, sums["tokens"] or 0, sums["kinds"])


def for_documents(model: Model, docs: DataFrame) -> Model:
    """The model with values for the runs of further documents, too."""
    more = counted(docs, F.lit(False)).filter(F.col("kind") == RUN).select("key", "n", "m")
    both = model.runs.select("key", "n", "m").union(more).groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return Model(valued(both), model.words, model.tokens, model.kinds)


@dataclass(frozen=True)
class Hot:
    """The keys that occur most (sorted) and their values."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, times: str, value: str, most: int) -> tuple[Hot, int]:
        """At most `most` rows (key, ...), those that occur most, and how often one of them occurs at least.

        How many keys occur about how often is one row for each sixteenth of a power of two.
        """
        step = F.floor(F.log2(times) * 16).cast("int")
        steps = rows.groupBy(step.alias("step")).agg(F.count("*").alias("keys"), F.min(times).alias("least")).orderBy(F.desc("step")).collect()
        total, least = 0, 1 << 62
        for s in steps:
            total += s["keys"]
            if total > most:
                break
            least = s["least"]
        top = rows.filter(F.col(times) >= least).select("key", value).toArrow()
        order = np.argsort(k := top["key"].to_numpy())
        return cls(k[order], top[value].to_numpy()[order]), least


HEADS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, word_times array<long>, runs array<long>, run_times array<long>"


def rest_of(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different keys of each of n owners and how often each occurs; owners are in order."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    pairs = [np.unique(keys[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]
    return [k for k, _ in pairs], [c for _, c in pairs]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    A null or empty text is its end alone; a text of any length is cut into pieces.
    Rows with a null doc_id are in the training part; repeated rows count and are
    scored each; other columns don't matter; an empty table gives an empty result.
    A text with runs that the model has no values for has a null score (see
    for_documents).
    """
    spark = docs.sparkSession
    words, least_word = Hot.of(model.words, "n", "n", HOT_WORDS)
    runs, least_run = Hot.of(model.runs, "m", "log10", HOT_RUNS)
    shared = spark.sparkContext.broadcast((words, runs))  # of a fixed size
    unknown = math.log10(0.1 / model.denominator)
    denominator = model.denominator

    def make():
        from pyspark import TaskContext

        hot_words, hot_runs = shared.value
        log_of = np.append(np.log10((hot_words.values + 0.1) / denominator), 0.0)
        at_row = [TaskContext.get().partitionId() << 40]

        def head(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                texts = part["text"].to_pylist()
                w = words_of(part["text"], lower=True)
                n = np.diff(w.bounds) + 1
                hashes = np.insert(w.hashes, w.bounds[1:], END_WORD).view(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                at, known = found(hot_words.keys, hashes)
                base = np.bincount(owner, np.where(known, log_of[at], 0.0), len(n))
                n_known = np.bincount(owner, known, len(n)).astype(np.int64)
                rest = rest_of(hashes[~known], owner[~known], len(n))
                score, keys, owners = np.zeros(len(n)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for codes, text_of in runs_of(texts):
                    distinct, which = np.unique(codes.view(np.int64), return_inverse=True)
                    at, hit = found(hot_runs.keys, distinct)
                    value = np.where(hit, hot_runs.values[at] if len(hot_runs.values) else 0.0, 0.0)
                    score += np.bincount(text_of, value[which], len(n))
                    cold = ~hit[which]
                    keys.append(distinct[which[cold]])
                    owners.append(text_of[cold])
                cold_runs = rest_of(np.concatenate(keys), np.concatenate(owners), len(n))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (*rest, *cold_runs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at_row[0] + np.arange(len(n))), part["doc_id"], part["held_out"], pa.array(n, pa.int64()), pa.array(n_known), pa.array(base), pa.array(score), *lists],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "word_times", "runs", "run_times"],
                )
                at_row[0] += len(n)

        return head

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", is_held_out(F.col("doc_id")))
    heads = saved(map_batches(rows, make, HEADS), "heads")
    each = lambda keys, times: heads.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))
    of_words = each("words", "word_times").join(model.words.filter(F.col("n") < least_word), "key")
    of_words = of_words.groupBy("row").agg(F.sum("times").alias("cold"), F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / F.lit(denominator))).alias("cold_base"))
    of_runs = each("runs", "run_times").join(model.runs.filter(F.col("m") < least_run).select("key", "log10"), "key", "left")
    of_runs = of_runs.groupBy("row").agg(F.when(F.count("*") == F.count("log10"), F.sum(F.col("times") * F.col("log10"))).alias("cold_score"))
    n_known = F.col("known") + F.coalesce("cold", F.lit(0))
    all_hot = F.size("runs") == 0
    return heads.join(of_words, "row", "left").join(of_runs, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_base", F.lit(0.0)) + (F.col("n_tokens") - n_known) * unknown).alias("base_score"),
        F.when(all_hot, F.col("score")).otherwise(F.col("score") + F.col("cold_score")).alias("score"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learned(docs, ~is_held_out(F.col("doc_id"))))
