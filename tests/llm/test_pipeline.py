import hashlib

import corpus_pipeline
from test_decontaminate import slow_clean
from test_repeats import slow as slow_repeats
from test_simhash import slow_components

from orbweaver.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage_table(stage(spark, docs, SF), f"test-{k}")
        after.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == names
    good, unique, cut, clean, coded = after
    # the classifier keeps what is labelled good and drops junk; see test_quality for held-out rows
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fine = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in good for i in fine) >= 0.95 * len(fine)
    ids = sorted(good)
    group = slow_components([simhash.fingerprint(good[i].text) for i in ids])
    assert sorted(unique) == sorted({ids[g] for g in group})
    ids = sorted(unique)
    for i, w in zip(ids, slow_repeats([unique[i].text for i in ids]), strict=True):
        data = unique[i].text.encode()
        assert len(cut[i].text.encode()) <= len(data) - w[1] and len(cut[i].text.encode()) > len(data) - w[1] - 8 * max(1, w[2])
        assert cut[i].n_chars == (len(cut[i].text) if w[1] else unique[i].n_chars)
    assert sorted(cut) == ids
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == slow_clean([(i, r.text) for i, r in cut.items()], items)
    assert set(coded) == set(clean)
    for i, r in coded.items():
        assert r.decoded_sha256 == hashlib.sha256(clean[i].text.encode()).hexdigest()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and len({r.doc_id for r in got}) == len(got)
