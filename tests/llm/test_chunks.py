import random

import numpy as np
import public_tokenizers as p
import pytest
from tokenizers import Tokenizer

from cartulary.llm import chunks
from cartulary.llm.chunks import ChunkEncoder
from cartulary.llm.common import library_chunks, library_encoder
from cartulary.llm.words import span_hashes

BITS = ["a", "B", "é", "İ", " ", "  ", "\n", "\t", ".", ",", ";", "'s", "9", "́", "ß", "😀", "|", "$", "ÿ", "ñ", " ", " ", "　", "", "\x1c", "ǆ", "K"]
ODD = ["", " ", "a  b   c", "\n\nx y\r\n z", "don't  stop's, İ. é x  y\n", "1,2 .5, it's. we'll.\tq ", "<|endoftext|> a", "“q” r’ s – t", "ÀÉ ß. ªº µ; Ñandú!", "x" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_as_the_library_encodes(name):
    t = Tokenizer.from_file(p.path(name))
    rng = random.Random(3)
    texts = [None, *ODD, *("".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(1500))]
    for text, got in zip(texts, library_chunks(p.path(name)).encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_a_small_cache_gives_the_same():
    encode = library_encoder(p.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k * j}" for j in range(40)) for k in range(300)]
    large, small = ChunkEncoder(encode), ChunkEncoder(encode, limit=10_000)
    assert [x for t in texts for x in small.encode([t])] == list(large.encode(texts)) and sum(r.nbytes for r in small.runs) <= 10_000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_without_structure_of_their_own(name):
    t = Tokenizer.from_file(p.path(name))
    for n in (1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        got = [np.frombuffer(x, "<u2").tolist() for x in library_chunks(p.path(name)).encode([word, f"{other} {word}", other])]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in (word, f"{other} {word}", other)]
        data = np.frombuffer((word + other).encode(), np.uint8)
        a, b = span_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist()
        assert a != b


def test_a_shared_hash_gives_no_wrong_ids(monkeypatch):
    monkeypatch.setattr(chunks, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    texts = ["one two three", "two one " + "x" * 700, "a" * 700 + " " + "a" * 699 + "b"]
    for text, got in zip(texts, ChunkEncoder(library_encoder(p.path("byte_bpe_50k.json"))).encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids
