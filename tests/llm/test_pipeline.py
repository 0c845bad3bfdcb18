"""The pipeline's stages against plain versions of what they decide."""

import hashlib

import public_tokenizers
import pytest
from conftest_llm import brute_components
from test_mixing import plain_mix

import corpus_pipeline
from mergewright.llm import bpe, common

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    import tiktoken

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "source_mix", "byte_bpe"]
    docs, seen = common.documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    raw = common.documents(spark, SF)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r.doc_id for r in d.collect()} for d in (raw, *seen)]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    short = {r.doc_id for r in raw.collect() if len((r.text or "").split()) < 40}
    assert not short & ids[1]
    gone = ids[0] - ids[2] - short
    assert sum(truth.get(d) == 1 for d in gone) <= 0.05 * sum(v == 1 for v in truth.values())
    components = brute_components([(r.doc_id, r.text) for r in seen[1].collect()])
    assert ids[3] == {d for d, (_, c) in components.items() if c == d}
    rows = [(r.doc_id, r.text, r.source) for r in seen[2].collect()]
    times, _, _ = plain_mix(rows)
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted(d for (d, _, _), n in zip(rows, times, strict=True) for _ in range(n))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = {d: t for d, t, _ in rows}
    for r in seen[4].collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, enc.encode_ordinary(text[r.doc_id]))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, seen[4].collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_rows(spark, docs_of, odd_rows, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs_of(odd_rows), SF).count() >= 0
    assert stage(spark, docs_of([]), SF).count() == 0
