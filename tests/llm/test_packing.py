import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as p
from tokenizers import Tokenizer

from cartulary.llm import packing
from cartulary.llm.common import saved

VOCABULARY = p.path("byte_bpe_50k.json")


def check_places(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= size
    return bins


def test_local_search_empties_a_bin():
    lengths = np.array([6, 3, 5, 4, 2])  # two of 10: {6, 4}, {5, 3, 2}
    bins = packing.local_search([[0, 1], [2, 3], [4]], lengths, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(5))


def test_local_search_never_lowers_the_squares():
    rng = random.Random(3)
    for _ in range(50):
        lengths = np.array([rng.randrange(1, 100) for _ in range(60)])
        start = [[i] for i in range(60)]
        end = packing.local_search([list(b) for b in start], lengths, 100)
        squares = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)
        assert squares(end) >= squares(start) and len(end) <= len(start)
        assert sorted(i for b in end for i in b) == list(range(60)) and all(lengths[b].sum() <= 100 for b in end)


def test_every_underfull_bin_is_searched():
    lengths = np.array([*[70] * 120, 60, 35, 55, 40])  # 120 emptier bins can't help; {60, 40} fills one of the last two
    bins = packing.local_search([*([i] for i in range(120)), [120, 121], [122, 123]], lengths, 100)
    assert max(int(lengths[b].sum()) for b in bins) == 100


def test_pieces_and_places(spark, small):
    docs = small("documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "word " * 5000), (-3, "word " * 5000)], "doc_id long, text string"))
    got = packing.pack_documents(docs, VOCABULARY, with_ids=True).collect()
    t = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        first = (len(ids) - 1) % 2048 + 1
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if not k else start + 2048]
            want.append((r.doc_id is None, r.doc_id or 0, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), np.array(part, "<u4").tobytes()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    bins = check_places(got, 2048)
    assert len(bins) <= 1.01 * sum(r.length for r in got) / 2048 + 1


def test_many_shards(spark):
    cut = saved(spark.range(3000).selectExpr("id as doc_id", "1 + id % 700 as length", "'x' as offset", "id as __row", "id as row", "id as __shard", "id as fill"), "t")
    got = packing.placements(cut, 1024, shard_pieces=500).collect()
    assert len(got) == 3000 and {r.doc_id for r in got} == set(range(3000))
    assert all(r["__row"] == r.row == r["__shard"] == r.fill == r.doc_id for r in got)
    assert len(check_places(got, 1024)) <= 1.02 * sum(r.length for r in got) / 1024 + 6


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
