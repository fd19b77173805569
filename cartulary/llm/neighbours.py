"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into many small balanced parts: a first
balanced assignment around centres, then moves along the graph that keep more
neighbours together without filling a part over its limit.  A small network learns
which parts a vector's neighbours are in; it begins as the nearness to the parts'
centres.  Every row of the table is indexed under its most probable part.  A query
visits parts by falling probability until what it has seen is as much as sample
rows kept from training need for the recall asked for, and LEAST_CANDIDATES rows
at least; a table that has no more is searched whole.  What it visits is ranked
exactly.

Neighbouring numbers of parts share blocks of about BLOCK rows; a part with more,
as one with a very common vector, has several, by a hash.  A query goes to each
block once, with the parts it visits there; queries of a block are dealt by a hash
too.  The layout has a few numbers for each part, of which there are MOST_PARTS at
most.  A block gives out each query's best ten; before these meet by query, each
task keeps the best ten of those it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, mix64, saved, table

#: Rows that the parts are learned from at most (those with the smallest hash of their id), sample rows of a part, and parts at most.
SAMPLE_ROWS = 6144
PART_ROWS = 4
MOST_PARTS = 512
NEIGHBOURS = 10
QUERY_STEP = 100
#: Recall that the probability to be visited is chosen for, on sample rows kept from training.
RECALL = 0.92
LEAST_CANDIDATES = 200
SLACK = 1.1
HIDDEN = 32
BLOCK = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


def nearest(a: np.ndarray, b: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Indices in b of the k nearest of each row of a; `same`: a is b and a row isn't its own."""
    k = min(k, len(b) - same)
    out = [np.zeros((0, k), np.int64)]
    for at in range(0, len(a), 256):
        d = squared(a[at : at + 256], b)
        if same:
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """A part for each row, none with more than slack * its share, few graph edges between parts."""
    if parts < 2:
        return np.zeros(len(x), np.int64)
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(8):
        d = squared(x, centres)
        label, room = np.full(len(x), -1), np.full(parts, limit)
        two = np.partition(d, 1, axis=1)
        for i in np.argsort(two[:, 0] - two[:, 1]):  # those that have most to lose choose first
            p = int(np.where(room > 0, d[i], np.inf).argmin())
            label[i], room[p] = p, room[p] - 1
        centres = np.stack([x[label == p].mean(0) if (label == p).any() else centres[p] for p in range(parts)])
    edges = np.concatenate([np.column_stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.column_stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])])
    for _ in range(rounds):
        pull = np.zeros((len(x), parts), np.float32)
        np.add.at(pull, (edges[:, 0], label[edges[:, 1]]), 1)
        gain = pull.max(1) - pull[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            p = int(pull[i].argmax())
            if room[p] > 0:
                room[label[i]] += 1
                room[p] -= 1
                label[i], moved = p, moved + 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Router:
    """Probabilities of parts: a linear map and a network of one hidden layer, added up."""

    weights: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        direct, bias, a, b, c = self.weights
        x = x.astype(np.float32)
        z = x @ direct + bias + np.maximum(x @ a + b, 0) @ c
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_router(x: np.ndarray, target: np.ndarray, centres: np.ndarray, hidden: int = HIDDEN, epochs: int = 15, rate: float = 0.003, seed: int = 2) -> Router:
    """By Adam on the cross entropy against soft targets, from the nearness to the centres on."""
    rng = np.random.default_rng(seed)
    n, parts = x.shape[1], target.shape[1]
    sharp = 8.0 / max(float(np.sqrt((centres**2).sum(1)).mean() * np.sqrt((x**2).sum(1)).mean()), 1e-12)
    w = [sharp * centres.T, -0.5 * sharp * (centres**2).sum(1), rng.standard_normal((n, hidden)) * np.sqrt(2 / n) / max(float(np.sqrt((x**2).mean() * n)), 1e-12), np.zeros(hidden), np.zeros((hidden, parts))]
    w = [p.astype(np.float32) for p in w]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ w[2] + w[3], 0)
            z = x[rows] @ w[0] + w[1] + h @ w[4]
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - target[rows]) / max(len(rows), 1)
            dh = dz @ w[4].T * (h > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ dz + 1e-4 * w[0], dz.sum(0), x[rows].T @ dh + 1e-4 * w[2], dh.sum(0), h.T @ dz + 1e-4 * w[4])):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Router(tuple(w))


@dataclass(frozen=True)
class Index:
    """The router, and how much probability a query has seen before the last part that it visits."""

    router: Router
    parts: int
    enough: float

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is indexed under."""
        return self.router.probabilities(x).argmax(1) if len(x) else np.zeros(0, np.int64)

    def visits(self, x: np.ndarray, sizes: np.ndarray, least: int = LEAST_CANDIDATES) -> list[np.ndarray]:
        """The parts that each row visits, by number; sizes: rows indexed under each part."""
        p = self.router.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        seen = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        rows = np.cumsum(sizes[order], axis=1) - sizes[order]
        go = (seen <= self.enough) | (rows < least)
        return [np.sort(o[g & (sizes[o] > 0)]) for o, g in zip(order, go, strict=True)]


def learned(x: np.ndarray, most_parts: int = MOST_PARTS, recall: float = RECALL, part_rows: int = PART_ROWS) -> Index:
    """The index of a sample of at least two rows, learned in single precision."""
    x = x.astype(np.float32)
    parts = max(1, min(most_parts, len(x) // part_rows))
    graph = nearest(x, x, NEIGHBOURS, same=True)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1
    target /= target.sum(1, keepdims=True)
    held = np.arange(len(x)) % 8 == 0
    centres = np.stack([x[label == p].mean(0) if (label == p).any() else np.zeros(x.shape[1]) for p in range(parts)])
    router = fit_router(x[~held], target[~held], centres)
    p = router.probabilities(x)
    home = p.argmax(1)
    order = np.argsort(-p[held], axis=1, kind="stable")
    falling = np.take_along_axis(p[held], order, axis=1)
    before = np.empty_like(falling)
    np.put_along_axis(before, order, np.cumsum(falling, axis=1) - falling, axis=1)
    needed = np.take_along_axis(before, home[graph[held]], axis=1)  # seen before a neighbour's part comes
    return Index(router, parts, float(np.quantile(needed, recall)))


@dataclass(frozen=True)
class Layout:
    """Of each part: its first block, its number of blocks, and in how many groups the queries of its blocks are dealt."""

    first: np.ndarray
    blocks: np.ndarray
    groups: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, asked: np.ndarray, block: int) -> Layout:
        first, blocks, groups = (np.ones(len(sizes), np.int64) for _ in range(3))
        at, held, members = 0, 0, []
        for p, n in enumerate(sizes.tolist()):
            if held and held + n > block:
                groups[members] = max(1, -(-int(asked[members].sum()) // block))
                at, held, members = at + 1, 0, []
            first[p], blocks[p] = at, max(1, -(-n // block))
            held, members = held + n, [*members, p]
            if blocks[p] > 1:
                groups[members] = max(1, -(-int(asked[members].sum()) // block))
                at, held, members = at + int(blocks[p]), 0, []
        groups[members] = max(1, -(-int(asked[members].sum()) // block))
        return cls(first, blocks, groups)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v of rows with an id and a finite vector that isn't zero, of the most common length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("v", ok) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (length[0]["n"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


DEALT = "block long, y int, query boolean, id long, v array<double>, parts array<int>"


def search(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS, query_step: int = QUERY_STEP, sample_rows: int = SAMPLE_ROWS, most_parts: int = MOST_PARTS, recall: float = RECALL, block: int = BLOCK, least: int = LEAST_CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id query_step divides.

    Nearness is Euclidean distance in double precision; equal ones go by the
    smaller id.  A row isn't its own neighbour; of rows that repeat a query's id the
    one with the smallest vector asks, and none of them is a candidate of it.  Rows
    without an id, and vectors that are null, empty, zero or not finite take no
    part; nor do those of another length than the most common one, which are no
    distance away from it.  With k or fewer other rows all are returned.  Other
    columns don't matter; an empty table gives an empty result.
    """
    rows = usable(vectors, id_column, vector_column)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).toArrow()
    if sample.num_rows < 2:
        return rows.sparkSession.createDataFrame([], RESULT)
    index = rows.sparkSession.sparkContext.broadcast(learned(matrix(sample["v"].combine_chunks()), most_parts, recall))  # of a fixed size
    parts = index.value.parts

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(index.value.home(matrix(batch["v"])), pa.int32())], ["id", "v", "part"])

    placed = saved(map_batches(rows, lambda: place, "id long, v array<double>, part int"), "placed")
    sizes = by_part(placed.select("part"), parts)

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        visits = index.value.visits(matrix(batch["v"]), sizes, least) if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(visits, pa.list_(pa.int32()))], ["id", "v", "visits"])

    queries = placed.filter(F.col("id") % query_step == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = saved(map_batches(queries, lambda: ask, "id long, v array<double>, visits array<int>"), "asked")
    layout = Layout.of(sizes, by_part(asked.select(F.explode("visits").alias("part")), parts), block)

    def deal_targets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, part = batch["id"].to_numpy(), batch["part"].to_numpy()
        at = layout.first[part] + spread(ids, 1) % layout.blocks[part]
        n = layout.groups[part]
        row = np.repeat(np.arange(len(ids)), n)
        y = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield dealt_rows(at[row], y, False, batch.take(pa.array(row)), list(part[row][:, None]))

    def deal_queries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes = spread(batch["id"].to_numpy(), 2)
        row, at, y, wanted = [], [], [], []
        for k, visits in enumerate(batch["visits"]):
            v = visits.values.to_numpy()
            for p in v[layout.blocks[v] > 1].tolist():
                for x in range(int(layout.blocks[p])):
                    row.append(k), at.append(int(layout.first[p]) + x), wanted.append([p]), y.append(int(hashes[k] % layout.groups[p]))
            v = v[layout.blocks[v] == 1]
            for some in np.split(v, np.flatnonzero(np.diff(layout.first[v])) + 1) if len(v) else []:
                row.append(k), at.append(int(layout.first[some[0]])), wanted.append(some.tolist()), y.append(int(hashes[k] % layout.groups[some[0]]))
        yield dealt_rows(np.array(at, np.int64), np.array(y, np.int64), True, batch.take(pa.array(row, pa.int64())), wanted)

    dealt = map_batches(asked, lambda: deal_queries, DEALT).unionByName(map_batches(placed, lambda: deal_targets, DEALT))
    found = dealt.groupBy("block", "y").applyInArrow(lambda group: best_of(group, k), "query_id long, vec_id long, score double")
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


RESULT = "query_id long, rank int, vec_id long, score double"


def by_part(rows: DataFrame, parts: int) -> np.ndarray:
    """How many rows each part has: one number a part."""
    out = np.zeros(parts, np.int64)
    for r in rows.groupBy("part").count().collect():
        out[r["part"]] = r["count"]
    return out


def spread(ids: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(salt)) >> np.uint64(1)).astype(np.int64)


def dealt_rows(at: np.ndarray, y: np.ndarray, query: bool, rows: pa.RecordBatch, wanted: list) -> pa.RecordBatch:
    columns = [pa.array(at, pa.int64()), pa.array(y, pa.int32()), pa.array(np.full(len(at), query)), rows["id"], rows["v"], pa.array(wanted, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["block", "y", "query", "id", "v", "parts"])


def best_of(group: pa.Table, k: int) -> pa.Table:
    """The k nearest of a block's rows in the parts that each query visits; those about as near as the k-th are measured exactly."""
    is_query = group["query"].to_numpy(zero_copy_only=False)
    ids, v = group["id"].to_numpy(), matrix(group["v"].combine_chunks())
    parts = group["parts"].combine_chunks()
    out: tuple[list, ...] = ([], [], [])
    targets = np.flatnonzero(~is_query)
    home = parts.take(pa.array(targets)).flatten().to_numpy()
    order = np.argsort(home, kind="stable")
    targets, home = targets[order], home[order]
    for at in range(0, int(is_query.sum()), 256):
        q = np.flatnonzero(is_query)[at : at + 256]
        if not len(targets):
            break
        visits = parts.take(pa.array(q))
        asking, wanted = np.repeat(np.arange(len(q)), pc.list_value_length(visits).to_numpy()), visits.flatten().to_numpy()
        rough = np.full((len(q), len(targets)), np.inf)
        for p in np.unique(wanted):
            a, b = np.searchsorted(home, [p, p + 1])
            some = asking[wanted == p]
            rough[some, a:b] = squared(v[q[some]], v[targets[a:b]])
        rough[ids[q][:, None] == ids[targets][None, :]] = np.inf
        m = min(k, rough.shape[1])
        reach = np.partition(rough, m - 1, axis=1)[:, m - 1]
        margin = 1e-9 * (1 + (v[q] ** 2).sum(1))
        for row, i in enumerate(q):
            near = targets[np.isfinite(rough[row]) & (rough[row] <= reach[row] + margin[row])]
            score = np.sqrt(((v[near] - v[i]) ** 2).sum(1))
            first = np.lexsort((ids[near], score))[:k]
            for column, x in zip(out, ([ids[i]] * len(first), ids[near][first], score[first]), strict=True):
                column.extend(x)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def op9(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
