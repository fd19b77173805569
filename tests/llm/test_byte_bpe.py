import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as p
import tiktoken

from cartulary.llm import byte_bpe

RANKS = p.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "a  b   c", "\n\nx y\r\n z", "  lead", "trail  ", "x\x1c y\x1f\x1fz", "don't  stop's, İ. é x  y\n", "a\n \nb", "1,2 .5, it's. we'll.\tq ", " é.  I̧.", "<|endoftext|> a", "ab" * 3000, "=" * 999, " " * 500 + "x", "été déjà, vu. ñandú", "漢字かな交じり文", " a b　 c", "𝔘𝔫𝔦 😀😀👩‍👩‍👧"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_monoid_agrees_with_the_library(library):
    bpe = byte_bpe.loaded(RANKS, p.PATTERN)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abeinorst éñ,.\n 'AZ09çü|=") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rng.choice(["'", "l", "s", " ", "\n", "a", "1", ".", "\u3000", "''", "ve"]) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    for text in texts:
        want = library.encode_ordinary(text)
        for leaf in (1, 2, 3, 7, byte_bpe.LEAF_CHARS):
            assert np.frombuffer(b"".join(bpe.encoded(text, leaf).ids), "<u2").tolist() == want, (text, leaf)
        assert np.frombuffer(bpe.encode(text), "<u2").tolist() == want, text
        assert bpe.decode(want) == text.encode()


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words(library, n):
    bpe = byte_bpe.loaded(RANKS, p.PATTERN)
    word = thue_morse(n)
    for text in (word, word.translate(str.maketrans("ab", "ba")), f"{word} {word[::-1]}"):
        assert np.frombuffer(bpe.encode(text), "<u2").tolist() == library.encode_ordinary(text)


def test_a_long_text_without_spaces(library):
    text = "".join(random.Random(4).choices("abcdefgh", k=1 << 20))
    bpe = byte_bpe.loaded(RANKS, p.PATTERN)
    got = np.frombuffer(bpe.encode(text), "<u2").tolist()
    assert bpe.decode(got) == text.encode()
    pairs = set(zip(got, got[1:]))  # a sequence whose adjacent pairs all stay is the encoding of its bytes
    assert all(bpe.stays(a, b) for a, b in pairs)
    assert np.frombuffer(bpe.encode(text[:8000]), "<u2").tolist() == library.encode_ordinary(text[:8000])


def test_little_memory_gives_the_same(library):
    bpe = byte_bpe.ByteBpe(byte_bpe.loaded(RANKS, p.PATTERN).ranks, p.PATTERN)
    bpe.known.limit = 3000
    for text in [" ".join(f"w{k * j}" for j in range(40)) for k in range(100)]:
        assert np.frombuffer(bpe.encode(text), "<u2").tolist() == library.encode_ordinary(text)
    assert len(bpe.known) < 100 and len(bpe.known.old) < 100


def test_join_is_the_encoding_of_the_concatenation(library):
    bpe = byte_bpe.loaded(RANKS, p.PATTERN)
    rng = random.Random(6)
    for _ in range(400):
        raw = bytes(rng.choice(b"aeinrstthe") for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(raw))
        assert bpe.join(bpe.merge(raw[:cut]), bpe.merge(raw[cut:])) == bpe.merge(raw)
        assert bpe.tree(raw) == bpe.merge(raw)


def test_documents_round_trip(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "no id", "x"), (7, None, "x"), (3, ODD[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(df, RANKS, p.PATTERN), RANKS, p.PATTERN).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in out)
    want = sorted((i is None, i or 0, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert got == want
    assert byte_bpe.encode_documents(df.limit(0), RANKS, p.PATTERN).count() == 0


def test_query_digests(spark, small, library):
    docs = small("documents")
    want = {(r.doc_id, hashlib.sha256(np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op3(spark, small.dir).collect()}
    assert got == want
