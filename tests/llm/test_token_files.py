import zlib

import numpy as np
import public_tokenizers as p
from tokenizers import Tokenizer

from cartulary.llm import token_files
from cartulary.llm.common import fresh_path

VOCABULARY = p.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(VOCABULARY)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def test_files_hold_all_ids_in_order(spark):
    texts = {5: "one two", 3: None, 9: "", 1: "Déjà vu\n\n  again " * 700, 4: "x" * 5000, 2: "one two"}
    rows = [(k, t, 1) for k, t in texts.items()] + [(4, texts[4], 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    manifest = token_files.write_files(df, VOCABULARY, fresh_path(spark, "t"), length=16)
    want, at = [], 0
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library_ids(t)
        want.append((k, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_documents(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    flat = []
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        file = token_files.SequenceFile(r.sequences)
        assert len(file) == r.n_sequences
        some = [file[i] for i in range(len(file))]
        assert all(len(ids) == 16 and (mask[:-1] >= mask[1:]).all() for ids, mask in some)
        flat += [x for ids, mask in some for x in ids[mask].tolist()]
    assert np.array(flat, "<u4").tobytes() == b"".join(w[3] for w in want)


def test_batches_are_views_of_the_map(spark):
    df = spark.createDataFrame([(k, "word " * 3000) for k in range(3)], "doc_id long, text string").coalesce(1)
    r = token_files.write_files(df, VOCABULARY, fresh_path(spark, "t"), length=8).collect()[0]
    ids, _ = token_files.SequenceFile(r.sequences)[token_files.BATCH_ROWS + 3]
    assert len(ids) == 8 and not ids.flags.owndata


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_documents(token_files.write_files(df, VOCABULARY, fresh_path(spark, "t"))).count() == 0


def test_query(spark, small):
    want, at = [], 0
    for r in sorted(small("documents").collect(), key=lambda r: r.doc_id):
        ids = library_ids(r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.op4(spark, small.dir).collect())) == want
