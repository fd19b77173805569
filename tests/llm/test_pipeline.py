import public_tokenizers as p
from tokenizers import Tokenizer

import corpus_pipeline
from cartulary.llm import near_dedup, quality, secrets

from .test_near_dedup import brute as near_brute
from .test_packing import check_places


def test_run_against_brute_force(spark, small):
    docs = small("documents")
    trees = quality.train(docs, small("labels"))
    rows = {}
    for r in docs.collect():
        base, x = quality.measured(docs_array([r.text]))
        if not quality.base_failed(base)[0] and trees.score(x)[0] >= quality.KEEP_SCORE:
            rows[r.doc_id] = r.text
    keep = [i for _, i, _, c in near_brute(list(rows.items()), 5, 80) if i == c]
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(secrets.redact(rows[i]), add_special_tokens=False).ids) + 1 for i in keep}
    got = corpus_pipeline.run(spark, small.dir).collect()
    sums = {}
    for r in got:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert sums == want
    assert len(check_places(got, 2048)) <= 1.02 * sum(want.values()) / 2048 + 1


def docs_array(texts):
    import pyarrow as pa

    return pa.array(texts)


def test_stages_keep_the_columns(spark, small):
    docs = small("documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small.dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_stages_take_odd_rows(spark, small):
    rows = [(None, None, None, None, None), (1, "a b c " * 20, "en", "s", 3), (1, "a b c " * 20, "en", "s", 3), (2, "", None, "s", 0), (None, "x y z", "en", "s", 5)]
    df = spark.createDataFrame(rows, small("documents").schema)
    assert near_dedup.deduplicated(df).count() == 4
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, small.dir).count() <= df.count()
