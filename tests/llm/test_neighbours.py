import numpy as np
import pytest

from cartulary.llm import neighbours


def brute(rows, k, step):
    """query -> its nearest (score, id), over rows (id, vector) that take part."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % step == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            out[i] = sorted((s, j) for s, j in zip(d.tolist(), ids.tolist(), strict=True) if j != i)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(4).round(1).tolist()) for k in range(60)] + [(None, [1.0] * 4), (70, None), (71, [0.0] * 4), (72, [float("nan"), 1.0, 1.0, 1.0]), (73, [None, 1.0, 1.0, 1.0]), (74, [float("inf"), 1.0, 1.0, 1.0]), (75, [])]
    rows += [(80 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(25)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = found(neighbours.search(df, query_step=10, block=7))
    want = brute([(i, np.array(v, np.float32).tolist() if v is not None and None not in v else v) for i, v in rows], 10, 10)
    assert {q: [j for _, j in x] for q, x in got.items()} == {q: [j for _, j in x] for q, x in want.items()}
    assert all(a[0] == pytest.approx(b[0], rel=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))
    for few in (0, 1, 2, 5):
        some = df.filter("vec_id between 0 and 59").orderBy("vec_id").limit(few)
        assert neighbours.search(some).count() == max(0, few - 1)


def test_repeated_ids_ask_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    got = found(neighbours.search(spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>")))
    assert got == {0: [(1.0, 1), (1.0, 1), (10**0.5, 2), (10**0.5, 2)]}


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((300, 8)) + 6 * rng.standard_normal(8) for _ in range(4)])
    graph = neighbours.nearest(x, x, 10, same=True)
    label = neighbours.balanced_parts(x, graph, 4)
    assert np.bincount(label, minlength=4).max() <= np.ceil(1.1 * 300)
    assert (label[graph] == label[:, None]).mean() > 0.8


def test_blocks_hold_all_rows_and_queries():
    layout = neighbours.Layout.of(np.array([3, 0, 50, 4, 4, 4]), np.array([100, 0, 5, 1, 1, 1]), 10)
    assert layout.first.tolist() == [0, 0, 1, 6, 6, 7] and layout.blocks.tolist() == [1, 1, 5, 1, 1, 1]
    assert layout.groups.tolist() == [10, 10, 1, 1, 1, 1]


def clusters(rng, n, dims, groups):
    centres = 4 * rng.standard_normal((groups, dims))
    return centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dims))


def measured(x, ids, queries):
    """Recall of the index over all rows, and the share of rows read."""
    index = neighbours.learned(x[np.argsort(ids)][: neighbours.SAMPLE_ROWS])
    home = index.home(x)
    sizes = np.bincount(home, minlength=index.parts)
    hits = read = 0
    for q in queries:
        visits = index.visits(x[q : q + 1], sizes)[0]
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += np.isin(home[np.argsort(d)[:10]], visits).sum()
        read += sizes[visits].sum()
    return hits / (10 * len(queries)), read / (len(queries) * len(x))


def test_clustered_rows_are_read_in_small_part():
    rng = np.random.default_rng(5)
    x = clusters(rng, 6000, 32, 60)
    recall, share = measured(x, rng.permutation(len(x)), rng.choice(len(x), 200, replace=False))
    assert recall >= 0.9 and share <= 0.1


def test_recall_of_the_query(spark):
    at = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    want, got = brute(rows, 10, 100), found(neighbours.op9(spark, at))
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in got)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    x = np.array([v for _, v in rows], float)
    recall, share = measured(x, np.array([i for i, _ in rows]), [k for k, (i, _) in enumerate(rows) if i % 20 == 0])
    print("recall", hits / sum(map(len, want.values())), recall, "share read", share)
    assert recall >= 0.9 and share <= 0.3
