import random

import public_tokenizers as p
import pytest
from tokenizers import Tokenizer

from cartulary.llm import edit_counts
from cartulary.llm.common import library_chunks, saved

VOCABULARY = p.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def full():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def some_text(rng, n):
    return "".join(rng.choice(["a", "be", " ", " ", "\n", "  ", "x1", "été", ".", ",", "'s", "99", "\t", "😀"]) for _ in range(n))


def tree_of(text):
    count = edit_counts.counter(library_chunks(VOCABULARY))
    leaves = edit_counts.leaves_of(text)
    return edit_counts.CountTree(leaves, [count(x) for x in leaves], count)


def masked_counts(df):
    return edit_counts.updated(edit_counts.with_masks(edit_counts.build(df, VOCABULARY)), VOCABULARY)


def test_random_edits(full):
    rng = random.Random(7)
    for size in (0, 3, 200, 4000):
        for _ in range(5):
            text = some_text(rng, size)
            tree = tree_of(text)
            assert tree.n_tokens == full(text)
            for _ in range(12):
                a = rng.randrange(len(text) + 1)
                b = min(len(text), a + rng.choice([0, 0, 1, 3, 40, 900]))
                new = some_text(rng, rng.choice([0, 1, 2, 30, 3000 if size else 0]))
                text = text[:a] + new + text[b:]
                tree.edit(a, b, new)
                assert tree.text() == text and tree.n_chars == len(text)
                assert tree.n_tokens == full(text)


def test_only_the_region_is_encoded_again(full):
    text = "some words here and there. " * 5000
    tree = tree_of(text)
    tree.edit(70_000, 70_003, "xyz")
    assert tree.encoded < 4 * edit_counts.LEAF_CHARS
    assert tree.n_tokens == full(text[:70_000] + "xyz" + text[70_003:])


def test_bad_places_are_refused():
    tree = tree_of("abc")
    for a, b in ((-1, 2), (2, 1), (0, 4)):
        with pytest.raises(IndexError):
            tree.edit(a, b, "")


def test_rows(spark, full):
    rows = [(1, None, 0), (2, "", 0), (None, "call 0123456789 or mail a.b@c.example.org", 0), (3, "9" * 9000, 0), (4, "x" * 70_000, 0), (2, "12345 12345", 0), (2, "12345 12345", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_edits, r.n_tokens_after) for r in masked_counts(df).collect())
    want = sorted((str(i), full(t), len(edit_counts.masks(t or "")), full(masked(t))) for i, t, _ in rows)
    assert got == want
    assert masked_counts(df.limit(0)).count() == 0


def masked(text):
    return edit_counts.MASKED.sub(lambda m: "<mail>" if "@" in m[0] else "<number>", text or "")


def test_stored_trees_follow_tables_of_edits(spark, full):
    rng = random.Random(11)
    texts = {k: some_text(rng, 300 * k) for k in range(8)}
    df = spark.createDataFrame([*texts.items(), (None, "x y")], "doc_id long, text string")
    trees = edit_counts.build(df, VOCABULARY)
    for _ in range(2):
        rows = []
        for k in range(1, 8):
            for seq in range(rng.randrange(4)):
                a = rng.randrange(len(texts[k]) + 1)
                b, new = min(len(texts[k]), a + rng.choice([0, 5, 300])), some_text(rng, rng.choice([0, 3, 500]))
                rows.append((k, seq, a, b, new))
                texts[k] = texts[k][:a] + new + texts[k][b:]
        rng.shuffle(rows)
        edits = spark.createDataFrame([*rows, (99, 0, 0, 0, "no tree"), (None, 0, 0, 0, "no id")], "doc_id long, seq int, start long, end long, new string")
        trees = saved(edit_counts.updated(edit_counts.with_edits(trees, edits), VOCABULARY), "after")
        got = {r.doc_id: (r.text, r.n_tokens_after, sum(r.tokens), sum(r.chars)) for r in trees.collect()}
        assert got == {k: (t, full(t), full(t), len(t)) for k, t in [*texts.items(), (None, "x y")]}


def test_long_addresses_and_runs_are_masked_whole(full):
    mail = "a" * 200 + "@" + ".".join(["b" * 90] * 12) + ".org"
    assert masked(f"to {mail} now") == "to <mail> now"
    assert masked("x" * 200_000) == "x" * 200_000


def test_query(spark, small, full):
    got = sorted((r.doc_id, r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in edit_counts.op5(spark, small.dir).collect())
    assert got == sorted((r.doc_id, full(r.text), full(masked(r.text)), len(masked(r.text))) for r in small("documents").collect())
