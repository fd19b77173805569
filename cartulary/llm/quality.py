"""Quality rules: gradient-boosted trees over document statistics.

Trees are trained on a bounded sample of labelled documents by histogram boosting
with logistic loss.  Chosen statistics are monotonic: more symbols, repeated lines,
repeated windows or capitals can only lower a document's score.  A trained model
is three node arrays (feature, threshold, value) of complete binary trees, so a
batch of documents is scored by one vectorised descent over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, map_batches, slices, table
from .words import windows, words_of

WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that training uses at most (those with the smallest hash of their doc_id).
SAMPLE_ROWS = 8000
#: A document that passes the base rules goes only if the trees call it good with less than this.
KEEP_SCORE = 0.4

#: Statistics of a document and the direction in which each may move the score (0: any).
STATISTICS = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "capital_share": -1,
    "mark_share": -1,
    "digit_share": -1,
    "stray_mark_share": -1,
    "distinct_share": 0,
    "words_a_line": 0,
}
DIRECTIONS = np.array(list(STATISTICS.values()))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "space": IS_SPACE,
    "point": ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)),  # first bytes of code points
    "symbol": _set(SYMBOLS),
    "capital": _set(bytes(range(65, 91))),
    "letter": _set(bytes(range(65, 91)) + bytes(range(97, 123))),
    "mark": _set(b"!?"),
    "stray": _set(b"|_=~^\\/@{}[]+"),
    "digit": _set(b"0123456789"),
}


def measured(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and the matrix of its STATISTICS."""
    parts = [(t or "").encode() for t in texts.to_pylist()]
    data = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)[:-1]
    n = {k: np.add.reduceat(c[data], begins, dtype=np.int64) for k, c in _CLASSES.items()}
    n["point"] -= 1  # the separator
    w = words_of(texts, lower=False)
    n_words = np.diff(w.bounds)
    five = windows(w.hashes, WINDOW)
    repeats, distinct, dup_lines, lines = (np.zeros(len(parts), np.int64) for _ in range(4))
    for k, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        distinct[k] = len(np.unique(w.hashes[a:b]))
        if b - a > WINDOW:
            repeats[k] = _covered(five[a : b - WINDOW + 1])
        with_word = [x for x in parts[k].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[k], dup_lines[k] = len(with_word), len(with_word) - len(set(with_word))
    base = dict(zip(BASE, (n_words, n["point"] - n["space"], n["symbol"], dup_lines, repeats), strict=True))
    some = np.maximum(n_words, 1)
    chars = np.maximum(base["word_chars"], 1)
    columns = (np.log1p(n_words), base["word_chars"] / some, n["symbol"] / chars, dup_lines / np.maximum(lines, 1), repeats / some, n["capital"] / np.maximum(n["letter"], 1), n["mark"] / chars, n["digit"] / chars, n["stray"] / chars, distinct / some, n_words / np.maximum(lines, 1))
    return base, np.column_stack(columns).astype(np.float64)


def _covered(hashes: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    if len(counts) == len(hashes):
        return 0
    steps = np.zeros(len(hashes) + WINDOW, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return int((np.cumsum(steps) > 0).sum())


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])


@dataclass(frozen=True)
class Trees:
    """Node arrays of complete binary trees, one row a tree; node k has children 2k+1 and 2k+2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        if not len(x) or not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.start + self.value[tree, node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 48, rate: float = 0.2, least: int = 12, ridge: float = 1.0, directions: np.ndarray = DIRECTIONS) -> Trees:
    """Boosted trees; with labels of one class only, a constant score."""
    if not len(y) or y.min() == y.max():
        return Trees(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 4.0, *(np.zeros((0, 0), t) for t in (np.int64, float, float)), depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    size = 2 ** (depth + 1) - 1
    out = [np.zeros((trees, size), t) for t in (np.int64, float, float)]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        node = _grow(out, t, binned, cuts, p - y, p * (1 - p), depth, least, ridge, rate, directions)
        margin += out[2][t, node]
    return Trees(start, *out, depth)


def _grow(out: list[np.ndarray], t: int, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float, rate: float, directions: np.ndarray) -> np.ndarray:
    """Fills row t of the node arrays; returns each row's leaf.  low/high: what a node's value may be."""
    feature, threshold, value = out
    node = np.zeros(len(g), np.int64)
    low, high = {0: -np.inf}, {0: np.inf}
    first_leaf = 2**depth - 1
    for k in range(first_leaf):
        rows = np.flatnonzero(node == k)
        feature[t, k], threshold[t, k] = 0, np.inf  # without a split all go left
        best, split = 1e-6, None
        if len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                n_bins = len(c) + 1
                if n_bins < 2:
                    continue
                gs, hs, ns = (np.bincount(binned[rows, f], weights, n_bins).cumsum()[:-1] for weights in (g[rows], h[rows], None))
                ga, ha, na = g[rows].sum(), h[rows].sum(), len(rows)
                left, right = (np.clip(-a / (b + ridge), low[k], high[k]) for a, b in ((gs, hs), (ga - gs, ha - hs)))
                part = lambda a, b, v: -(a * v + (b + ridge) * v * v / 2)
                whole = np.clip(-ga / (ha + ridge), low[k], high[k])
                gain = part(gs, hs, left) + part(ga - gs, ha - hs, right) - part(ga, ha, whole)
                gain[(ns < least) | (na - ns < least) | (directions[f] * (right - left) < 0)] = -np.inf
                if gain.max() > best:
                    i = int(gain.argmax())
                    best, split = gain[i], (f, i, (left[i] + right[i]) / 2)
        a, b = 2 * k + 1, 2 * k + 2
        low[a], high[a], low[b], high[b] = low[k], high[k], low[k], high[k]
        if split is None:
            node[rows] = a
            continue
        f, i, middle = split
        feature[t, k], threshold[t, k] = f, cuts[f][i]
        if directions[f] < 0:
            low[a], high[b] = middle, middle
        elif directions[f] > 0:
            high[a], low[b] = middle, middle
        node[rows] = np.where(binned[rows, f] > i, b, a)
    for k in range(first_leaf, 2 ** (depth + 1) - 1):
        rows = node == k
        value[t, k] = rate * np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low[k], high[k]) if rows.any() else 0.0
    return node


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `sample_rows` labelled rows.

    The ids of the sample go to the driver and out again, then the statistics of
    its documents; both are bounded by sample_rows, whatever the tables.  Rows
    whose doc_id or quality is null, or quality neither 0 nor 1, take no part.
    """
    some = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality in (0, 1)")
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows).collect()
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.quality) for r in some], "doc_id long, quality int"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("doc_id", "text", "quality")

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            x = measured(part["text"])[1]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["quality"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = map_batches(rows, lambda: measure, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows).collect()
    return fit(np.array([r.x for r in got], float).reshape(-1, len(STATISTICS)), np.array([r.quality for r in got], float))


def judged(docs: DataFrame, trees: Trees, keep_score: float = KEEP_SCORE) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of each row.

    A null or empty text has no words and fails; a text of any length is measured
    whole, by one worker beside a batch of about a megabyte.  Null doc_ids and
    repeated rows stay as they are, other columns don't matter; an empty table gives
    an empty result.
    """

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            base, x = measured(part["text"])
            failed, score = base_failed(base), trees.score(x)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(base[k], pa.int64()) for k in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_score))], ["doc_id", *BASE, "base_failed", "score", "kept"])

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in BASE), "base_failed boolean", "score double", "kept boolean"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), lambda: judge, schema)


def only_kept(docs: DataFrame, trees: Trees, keep_score: float = KEEP_SCORE) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            base, x = measured(part["text"])
            yield part.filter(pa.array(~base_failed(base) & (trees.score(x) >= keep_score)))

    return map_batches(docs, lambda: keep, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
