import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cartulary.llm import near_dedup
from cartulary.llm.words import words_of


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, width=3, percent=85):
    """(doc_id, n, component) of each row: all pairs of full sets."""
    sets = []
    for _, text in rows:
        w = word_list(text)
        sets.append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i is None, i or 0, len(s), least.get(find(k), 0) if i is not None else 0) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))))


def ours(df, rule=near_dedup.OP6):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.classified(df, rule).collect())


def family(rng, n, base, least_edits, most_edits):
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(least_edits, most_edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        yield " ".join(w)


def test_words_are_the_contract_words():
    texts = ["", None, "One  two\tÉA\x0b x\x1cy", " a ", "x" * 100, "\n\n", "one"]
    w = words_of(pa.array(texts), lower=True)
    assert np.diff(w.bounds).tolist() == [len(word_list(t)) for t in texts]
    assert w.n_bytes.tolist() == [sum(len(x.encode()) for x in word_list(t)) for t in texts]
    assert w.hashes[0] == w.hashes[w.bounds[6]] and len(set(w.hashes.tolist())) == len({x for t in texts for x in word_list(t)})


def test_families_against_all_pairs(spark):
    rng = random.Random(2)
    rows, k = [], 0
    for f in range(6):
        base = [f"b{f}_{i}" for i in range(120)]
        for text in family(rng, 40, base, 0, (3, 6, 9, 14, 20, 30)[f]):
            rows.append((k * 7 % 1009, text))
            k += 1
    rows += [(2000, ""), (2001, None), (2002, "  \n"), (2003, "two words"), (2004, "Two WORDS"), (2005, "one"), (2006, rows[0][1]), (2006, rows[0][1])]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, id int, key string")
    assert ours(df) == brute(rows)
    assert ours(df, near_dedup.Rule()) == brute(rows, 5, 80)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "other text here now"), (2, "other text here now"), (3, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.classified(df, near_dedup.OP6).collect()
    assert sorted((r.n_shingles, str(r.doc_id), str(r.component_id), r.kept) for r in got) == [(2, "1", "1", True), (2, "1", "1", True), (2, "2", "1", False), (2, "3", "1", False), (2, "None", "None", True)]


def test_empty_table(spark):
    assert near_dedup.classified(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 900), (900, 501)], "a long, b long")
    got = {r.id: r.comp for r in near_dedup.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 900: 500, 501: 500}


def test_query_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    got = sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.op6(spark, small.dir).collect())
    assert got == brute(rows)


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 700)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = list(enumerate(family(rng, 150, base, 4, 14)))
    assert ours(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_passage_added_or_cut(spark):
    """Copies with 18 to 24 percent more or less: five words and 80 percent link them, where similar enough."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:810])), (3, " ".join(words[210:])), (4, " ".join([*words, *(f"x{i}" for i in range(240))])), (5, " ".join([*words, *(f"y{i}" for i in range(260))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ours(df, near_dedup.Rule())
    assert got == brute(rows, 5, 80) and [c for *_, c in got] == [1, 1, 3, 1, 5]


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 70_001}" for k in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 3_000_000), (4, "x" * 3_000_000), (5, "short text of five words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.classified(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_structured_words_are_told_apart(spark):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    assert [r[3] for r in ours(spark.createDataFrame(rows, "doc_id long, text string"))] == [1, 2]


def test_deduplicated_rows_go_each_by_its_own_text(spark):
    rows = [(1, "a b c d e f", "p"), (1, "a b c d e f", "q"), (1, "other words that stand here now", "r"), (2, "A b c d e f", "s"), (3, "other words that stand here now", "t"), (0, "third text of some more words", "u"), (4, "third text of some more words", "v"), (4, "last text with words of its own", "w"), (None, "a b c d e f", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string")
    got = sorted((str(r.doc_id), r.text[:5]) for r in near_dedup.deduplicated(df).collect())
    assert got == [("0", "third"), ("1", "a b c"), ("1", "other"), ("4", "last "), ("None", "a b c")]
    assert near_dedup.deduplicated(df).columns == df.columns


@pytest.mark.parametrize("rule", [near_dedup.OP6, near_dedup.Rule()])
def test_tables_miss_few(rule):
    q = (rule.percent / 100) ** near_dedup.PER_COLLECTION
    m = rule.collections
    assert (1 - q) ** m + m * q * (1 - q) ** (m - 1) < 1e-5 and m in (12, 15)
