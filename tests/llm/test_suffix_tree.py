import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cartulary.llm import suffix_tree as st


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute_base(rows):
    c = Counter(w for i, t in rows if not held_out(i) for w in [*word_list(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        words = [*word_list(t), None]
        yield i, held_out(i), len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)


def brute_tree(rows, divergence=st.DIVERGENCE):
    """log10 score of a text by dictionaries, the way the module's text says."""
    stream = lambda t: [st.END] * st.DEPTH + list("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()) + [st.END]
    counts = {}
    for i, t in rows:
        s = stream(t) if not held_out(i) else []
        for p in range(st.DEPTH, len(s)):
            for d in range(st.DEPTH + 1):
                counts.setdefault(tuple(s[p - d : p]), Counter())[s[p]] += 1
    rough, kept = {}, {()}

    def smoothed(context, parent):
        n = counts.get(context, Counter())
        total, kinds = sum(n.values()), len(n)
        if not context:
            return [(n[x] + 0.5) / (total + 0.5 * st.SYMBOLS) for x in range(st.SYMBOLS)]
        return [(n[x] + st.SMOOTHING * kinds * parent[x]) / (total + st.SMOOTHING * kinds) for x in range(st.SYMBOLS)]

    for context in sorted((c for c, n in counts.items() if sum(n.values()) >= (st.LEAST_COUNT if len(c) > 1 else 1)), key=len):
        parent = rough[context[1:]] if context else None
        rough[context] = smoothed(context, parent)
        if len(context) < 2:
            kept.add(context)
            continue
        n, total = counts[context], sum(counts[context].values())
        if 2 * sum(c * math.log(c / total / parent[x]) for x, c in n.items()) > divergence * len(n):
            kept.update(context[k:] for k in range(len(context)))
    final = {}

    def distribution(context):
        while context not in kept:
            context = context[1:]
        if context not in final:
            final[context] = smoothed(context, distribution(context[1:]) if context else None)
        return final[context]

    def score(t):
        s = stream(t)
        return sum(math.log10(distribution(tuple(s[p - st.DEPTH : p]))[s[p]]) for p in range(st.DEPTH, len(s)))

    return score


def compare(rows, got):
    score = brute_tree(rows)
    want = sorted((str(i), *rest, score(t)) for (i, *rest), (_, t) in zip(brute_base(rows), rows, strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def ours(df):
    return st.scored(df, st.learned(df, ~st.is_held_out(df.doc_id)))


TEXTS = [None, "", " ", "The cat sat. " * 30, "the Cat\tSAT\x0b on 漢字 😀", "x" * 3000, "".join(chr(200 + k % 90) for k in range(900)), "кот сидел на ковре и смотрел " * 8, "the dog sat on the mat " * 9]


@pytest.mark.parametrize("hot", [5, 1 << 18])
def test_odd_rows(spark, monkeypatch, hot):
    for name, value in {"HOT_WORDS": hot, "HOT_RUNS": hot, "PIECE_BYTES": 700 if hot == 5 else st.PIECE_BYTES, "TASK_RUNS": 300 if hot == 5 else st.TASK_RUNS}.items():
        monkeypatch.setattr(st, name, value)
    rows = [(k if k % 11 else None, TEXTS[k % len(TEXTS)]) for k in range(60)] + [(3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, held_out boolean")
    compare(rows, ours(df).collect())
    assert ours(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    compare(rows, st.op7(spark, small.dir).collect())


def test_further_documents(spark):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(40)]
    more = [(k, t) for k, t in zip((k for k in range(100, 300) if held_out(k)), ["the cat sat on a mat", "ковёр", "quite other text: 0123"], strict=False)]
    df, new = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, more))
    model = st.learned(df, ~st.is_held_out(df.doc_id))
    assert any(r.score is None for r in st.scored(new, model).collect())
    score = brute_tree(rows)
    got = {r.doc_id: r.score for r in st.scored(new, st.for_documents(model, new)).collect()}
    assert got == {i: pytest.approx(score(t), rel=1e-9) for i, t in more}


def test_distributions_sum_to_one():
    rng = np.random.default_rng(3)
    symbols = rng.integers(97, 101, 4000)
    text = bytes(symbols.tolist()).decode()
    codes = np.concatenate([c for c, _ in st.runs_of([text])])
    key, n = np.unique(codes, return_counts=True)
    pairs = st.pair_probabilities([(int(p), int(c)) for p, c in zip(*np.unique(codes & np.uint64(0xFFFF), return_counts=True), strict=True)])
    assert np.allclose(pairs.sum(1), 1)
    levels = st.subtrees(key, n, pairs)
    assert len(levels[-1].contexts) > 0
    for context in key[:: len(key) // 50] >> np.uint64(8):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** st.log10_of(every, levels, pairs)).sum() == pytest.approx(1)


def test_held_out_texts_score_better_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in ours(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_contexts_stay_in_a_larger_corpus(spark):
    """Seen five times among 1.5 million symbols: kept by count and divergence, whatever the corpus."""
    rows = [(k, "the cat sat on the mat and " * 1200) for k in range(50)] + [(k, "the quick zebra") for k in range(100, 130) if not held_out(k)][:5] + [(k, "quick zebra") for k in range(200, 260) if held_out(k)]
    compare(rows, ours(spark.createDataFrame(rows, "doc_id long, text string")).collect())
