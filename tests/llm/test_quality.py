import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cartulary.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(five)
    covered = {k + j for k, x in enumerate(five) if often[x] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def odd_texts():
    rng = random.Random(4)
    some = [" ".join(rng.choice(["a", "b", "é", "c\n", "|#", "\td", "x\x1cy", "\n\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    return [None, "", " ", "\n", "one", "word " * 4000, "a b c d e f a b c d e", "l m\nl m\n \n \nl m", "漢字 😀 é", *some]


def test_base_counts():
    texts = odd_texts()
    base, x = quality.measured(pa.array(texts))
    failed = quality.base_failed(base)
    for k, t in enumerate(texts):
        assert (*(int(base[n][k]) for n in quality.BASE), bool(failed[k])) == brute(t), t
    assert np.isfinite(x).all()


def test_trees_learn_and_keep_directions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.05 * rng.standard_normal(3000) < 0.6).astype(float)
    directions = np.array([-1, 0, 0])
    trees = quality.fit(x[:2000], y[:2000], directions=directions)
    assert ((trees.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.9
    grid = np.column_stack([np.linspace(-0.2, 1.2, 200), *rng.random((2, 1)).repeat(200, 1)])
    assert (np.diff(trees.score(grid)) <= 1e-12).all()


def test_constant_without_both_classes():
    assert quality.fit(np.zeros((0, 11)), np.zeros(0)).score(np.zeros((2, 11))).min() > 0.5
    assert quality.fit(np.zeros((5, 11)), np.ones(5)).score(np.zeros((2, 11))).min() > 0.5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = "crc32(cast(doc_id as string)) % 4"
    trees = quality.train(docs, labels.where(f"{fold} <> 0"))
    got = quality.judged(docs, trees).join(labels.where(f"{fold} = 0"), "doc_id").where("not base_failed").collect()
    assert len(got) > 50 and np.mean([r.kept == (r.quality == 1) for r in got]) > 0.95


def test_odd_rows_and_columns(spark):
    rows = [(k if k % 9 else None, t, 1.0) for k, t in enumerate(odd_texts())] + [(5, "again", 1.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    trees = quality.train(df, spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int"))
    got = sorted((str(r.doc_id), *(r[n] for n in quality.BASE), r.base_failed) for r in quality.judged(df, trees).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, _ in rows)
    kept = quality.only_kept(df, trees)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in quality.judged(df, trees).collect())
    assert quality.judged(df.limit(0), trees).count() == 0 and quality.only_kept(df.limit(0), trees).count() == 0


def test_query(spark, small):
    got = {(r.doc_id, *(r[n] for n in quality.BASE), r.base_failed) for r in quality.op1(spark, small.dir).collect()}
    assert got == {(r.doc_id, *brute(r.text)) for r in small("documents").collect()}
