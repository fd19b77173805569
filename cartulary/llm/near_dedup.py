"""Near-duplicate classes by MinHash with tensored banding, confirmed on full sets.

A document's set is that of its distinct word shingles, as 64-bit hashes.  Sets
that are equal form a class and go on as one, so thousands of copies cost as
much as one row.  Small collections of ``PER_COLLECTION`` minhash values each are
computed; every pair of collections gives one table key.  12 x 2 values thus serve
66 tables of four values, where independent tables would need 264.  A pair of
similarity s shares a table unless fewer than two collections agree.  A rule takes
as many collections as miss at most 1 in 100,000 pairs right at its threshold: 12
for 0.85 (7 in a million; 1 in 10 million at 0.9), 15 for 0.8 (6 in a million).

Tables are never multiplied out.  Each bucket first links its members to one
pivot, the one with the smallest share of shingles that no other candidate has.
That settles the groups of near copies.  Buckets that still hold several
components make families; the members outside a family's largest component, the
strays, are queries against all its members, in blocks of bounded size (see
stray_links).
Candidates with so many shingles of their own that the similarity is out of
reach with any set drop out before.  All links are confirmed on full sets, so no
pair that shares a table is lost and none is wrong.  Components come from
repeated smallest-neighbour steps with pointer jumping over stored tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free_name, map_batches, mix64, saved, slices, table
from .words import windows, words_of

PER_COLLECTION = 2
#: Chance that a pair right at the threshold shares no table.
MISS = 1e-5
#: Expected shingles of a block of a family, all its sets together.
BLOCK_SHINGLES = 1 << 17


@dataclass(frozen=True)
class Rule:
    """Links: 100 * intersection >= percent * union of the sets of `width`-word shingles."""

    width: int = 5
    percent: int = 80

    @property
    def collections(self) -> int:
        """The fewest collections that miss at most MISS at the threshold."""
        q, m = (self.percent / 100) ** PER_COLLECTION, 2
        while (1 - q) ** m + m * q * (1 - q) ** (m - 1) > MISS:
            m += 1
        return m

    def near(self, both, either):
        """Whether sets with so many shingles in both, of so many in either, are linked."""
        return 100 * both >= self.percent * either


#: The rule of the op6 query, which its contract fixes; all else takes five words and 80 percent.
OP6 = Rule(3, 85)

SKETCH = "doc_id long, n long, fp binary, coll array<long>"


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of n minhash functions, always the same."""
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than `width`: all of them as one."""
    w = words_of(column, lower=True)
    h = windows(w.hashes, width)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(h[a : b - width + 1])
        elif b > a:
            yield windows(w.hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def collections_of(s: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """One value for each collection of minhash values."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 8192):
        part = s[at : at + 8192]
        x = part[None, :] * factors[:, None] + shifts[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=1), out=least)
    values = least.reshape(-1, PER_COLLECTION)
    out = mix64(values[:, 0])
    for k in range(1, PER_COLLECTION):
        out = mix64(out * np.uint64(31) + values[:, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (size of the set), fp (128-bit fingerprint of the set), coll (one value a collection)."""
    factors, shifts = hash_functions(rule.collections * PER_COLLECTION)

    def make():
        def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                sets = list(shingle_sets(part["text"], rule.width))
                coll = [collections_of(s, factors, shifts) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array(coll, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "coll"])

        return sketch

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, SKETCH)


def table_keys(classes: DataFrame, n_collections: int) -> DataFrame:
    """One row for each class and pair of collections: key, id."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(n_collections), 2)])
    key = lambda p: F.xxhash64(p["i"], p["j"], F.element_at("coll", p["i"] + 1), F.element_at("coll", p["j"] + 1))
    return classes.select("id", F.explode(F.transform(pairs, key)).alias("key"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, comp: the smallest id that edges (a, b) connect it to; only ids that have edges.

    Each round takes the smallest label around and then the label of that label,
    over tables stored in the shared folder.  A chain of n links takes about
    log n rounds.
    """
    both = saved(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))), "edges")
    stored = labels = saved(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("other"), F.col("comp").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "c").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("comp").alias("j"))
        new = saved(step.join(jump, "to").select("id", F.col("comp").alias("old"), F.least("to", "j").alias("comp")), "labels")
        changed = new.filter("old <> comp").limit(1).count()
        dropped(stored)
        stored, labels = new, new.select("id", "comp")
        if not changed:
            dropped(both)
            return labels
    raise RuntimeError("components haven't settled; raise most_rounds")


def confirmed(edges: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those edges (a, b) whose full sets are similar enough."""
    one = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s_{k}"))
    joined = edges.join(one("a"), "a").join(one("b"), "b")

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch["s_a"], batch["s_b"], strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(rule.near(both, len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(joined.select("a", "b", "s_a", "s_b"), lambda: check, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, shingles of the wanted classes (id, doc_id, fp), from the texts of their first documents."""
    found = wanted.select("id", F.col("doc_id").alias("want"), F.col("fp").alias("want_fp")).hint("shuffle_hash").join(docs.select(F.col("doc_id").cast("long").alias("want"), "text"), "want")

    def make():
        def compute(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                rows = [(i, s.view(np.int64)) for i, fp, s in zip(part["id"].to_pylist(), part["want_fp"].to_pylist(), shingle_sets(part["text"], width), strict=True) if fingerprint(s) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["id", "shingles"])

        return compute

    return map_batches(found.select("id", "want_fp", "text"), make, "id long, shingles array<long>").dropDuplicates(["id"])


def reachable(na, ca, nb, cb, rule: Rule):
    """Whether sets of na and nb shingles, of which ca and cb also occur elsewhere, can be similar enough."""
    return (100 + rule.percent) * F.least(ca, cb) >= rule.percent * (na + nb)


def links(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """All confirmed links (a, b) that decide components, of classes (id, doc_id, n, fp, coll)."""
    keys = table_keys(classes, rule.collections)
    shared = saved(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key"), "buckets")
    members = saved(keys.join(shared, "key").select("key", "id"), "members")
    ids = saved(members.select("id").distinct(), "candidates")
    sets = saved(full_sets(docs, classes.join(ids, "id", "left_semi"), rule.width), "sets")

    # of the candidates: the size of the set and how many of its shingles another candidate has too
    each = sets.select("id", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    facts = classes.select("id", "n").join(ids, "id", "left_semi").join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))
    alive = saved(facts.filter(reachable(F.col("n"), F.col("c"), F.col("c"), F.col("c"), rule)), "alive")

    live = members.join(alive, "id")
    best = live.groupBy("key").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("id")).alias("last"), "id", "n", "c")).alias("p"))
    met = saved(live.join(best, "key").select("key", "id", "n", "c", F.col("p.id").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.c").alias("p_c")), "met")
    star = met.filter((F.col("id") != F.col("pivot")) & reachable(F.col("n"), F.col("c"), F.col("p_n"), F.col("p_c"), rule))
    star = saved(confirmed(star.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), sets, rule), "star")
    strays = saved(stray_links(met.select("key", "id", "pivot"), components(star), sets, rule), "strays")
    dropped(shared, members, ids, sets, alive, met)
    return star.union(strays)


def stray_links(met: DataFrame, comps: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between different components of buckets that hold more than one, among met (key, id, pivot).

    Buckets that hold several components, chained by the members they share, are
    families.  In each family the members outside its largest component, the
    strays, are the queries against all its members.  Strays and members are dealt
    over blocks of about BLOCK_SHINGLES shingles, each kind over as many as it needs;
    a task holds one block of each at a time, and gives out only links.  A member
    goes to each block of strays, of which there is one while the strays are few.
    """
    named = saved(met.join(comps, "id", "left").select("key", "id", "pivot", F.coalesce("comp", "id").alias("comp")), "named")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    chained = saved(named.join(mixed, "key").select("id", "pivot", "comp").distinct(), "mixed")
    families = components(chained.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    of_sets = sets.select("id", F.size("shingles").alias("n"))
    rows = saved(families.withColumnRenamed("comp", "family").join(chained.select("id", "comp").distinct(), "id").join(of_sets, "id"), "families")
    sizes = rows.groupBy("family", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("members", "comp", "n")).alias("most"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("family", F.col("most.comp").alias("main"), blocks(F.col("n") - F.col("most.n")).alias("xs"), blocks(F.col("n")).alias("ys"))
    placed = rows.join(sizes, "family").withColumn("stray", F.col("comp") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ("family", "id", "comp", "stray")
    queries = placed.filter("stray").select(*common, F.lit(True).alias("query"), own("xs").alias("x"), each("ys").alias("y"))
    targets = placed.select(*common, F.lit(False).alias("query"), each("xs").alias("x"), own("ys").alias("y"))
    dealt = queries.union(targets).join(sets, "id")
    return dealt.groupBy("family", "x", "y").applyInArrow(lambda group: block_links(group, rule), "a long, b long")


def block_links(group: pa.Table, rule: Rule) -> pa.Table:
    """Links of the queries of one block with the targets of another, by the targets' inverted lists."""
    query = group["query"].to_numpy(zero_copy_only=False)
    ids, comp, stray = (group[c].to_numpy(zero_copy_only=False) for c in ("id", "comp", "stray"))
    sets = [x.values.to_numpy() for x in group["shingles"]]
    t = np.flatnonzero(~query)
    found: list[tuple[int, int]] = []
    if len(t) and query.any():
        sizes = np.array([len(sets[k]) for k in t])
        flat, owner = np.concatenate([sets[k] for k in t]), np.repeat(np.arange(len(t), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for k in np.flatnonzero(query):
            lo, hi = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
            both = np.zeros(len(t), np.int64)
            for part in np.array_split(np.arange(len(lo)), 1 + int((hi - lo).sum()) // BLOCK_SHINGLES):
                n = hi[part] - lo[part]
                at = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both += np.bincount(owner[at], minlength=len(t))
            near = rule.near(both, sizes + len(sets[k]) - both)
            near &= (comp[t] != comp[k]) & (~stray[t] | (ids[t] > ids[k]))
            found += [(min(ids[k], i), max(ids[k], i)) for i in ids[t[near]].tolist()]
    return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})


def decided(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, fp (of the set), n_shingles, component_id, kept of each row, as classified says."""
    rows = saved(sketches(docs, rule), "sketches")
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = rows.filter(real).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("coll").alias("coll"))
    # the id orders classes as their smallest doc_ids do, unless one doc_id has several texts
    classes = saved(classes.withColumn("id", F.col("doc_id")), "classes")
    repeated = classes.groupBy("id").count().filter("count > 1").limit(1).count()
    if repeated:
        classes = saved(classes.withColumn("id", F.xxhash64("fp")), "classes")
    comps = components(links(docs, classes, rule))
    if repeated:
        named = classes.join(comps, "id").groupBy("comp").agg(F.min("doc_id").alias("least"))
        comps = comps.join(named, "comp").select("id", F.col("least").alias("comp"))
    component = classes.join(comps, "id", "left").select("fp", F.coalesce("comp", "doc_id").alias("component_id"))
    columns = ("doc_id", "fp", F.col("n").alias("n_shingles"))
    linked = rows.filter(real).join(component, "fp").select(*columns, "component_id")
    alone = rows.filter(~real).select(*columns, F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def classified(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    component_id is the smallest doc_id that links reach, itself included; a
    document without words is alone.  Repeated rows get the same result each.  If
    one doc_id stands on several texts, each row goes by its own text.  Rows with
    a null doc_id are linked with nothing: their component_id is null and they are
    kept.  A text of any length is one set, held by one worker at a time.  Other
    columns don't matter; an empty table gives an empty result.
    """
    return decided(docs, rule).drop("fp")


def op6(spark, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), OP6)


def deduplicated(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with all columns of docs.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id and a set, one
    stays; rows of one doc_id with different sets are decided each by its own.
    Columns of any name are kept as they are.
    """
    found = saved(decided(docs, rule).filter("doc_id is not null"), "decided")
    id_name, fp_name = free_name("__kept", docs.columns), free_name("__fp", docs.columns)
    own = F.col("doc_id").cast("long")
    by_id = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    ids = saved(by_id.filter("kept").select(F.col("doc_id").alias(id_name), "rows"), "kept")
    once = docs.join(ids.filter("rows = 1").select(id_name).hint("shuffle_hash"), own == F.col(id_name), "left_semi")
    if ids.filter("rows > 1").limit(1).count():
        # rows that share an id: only these are told apart by their sets
        again = docs.join(ids.filter("rows > 1").select(id_name).hint("shuffle_hash"), own == F.col(id_name), "left_semi")
        keep = found.filter("kept").select(F.col("doc_id").alias(id_name), F.col("fp").alias(fp_name + "k")).distinct()
        marked = with_fingerprints(again, rule.width, fp_name)
        marked = marked.join(keep.hint("shuffle_hash"), (own == F.col(id_name)) & (F.col(fp_name) == F.col(fp_name + "k")), "left_semi")
        once = once.unionByName(marked.dropDuplicates(["doc_id", fp_name]).drop(fp_name))
    return once.unionByName(docs.filter("doc_id is null"))


def with_fingerprints(docs: DataFrame, width: int, name: str) -> DataFrame:
    """All rows and columns of docs, and the fingerprint of each row's set."""

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            prints = pa.array([fingerprint(s) for s in shingle_sets(part["text"], width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, prints], [*part.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    return map_batches(docs, lambda: mark, schema)
