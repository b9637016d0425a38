import random

import corpus_pipeline
import pytest
from test_repeats import sample, slow

from orbweaver.llm import repeats


@pytest.mark.parametrize("length", [3, 40, 240])
def test_short_lengths_against_brute_force(spark, length):
    texts = sample(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats_report(df, length=length).collect()}
    for i, w in enumerate(slow(texts, length)):
        assert got[i] == w, i


def test_stage_removes_a_passage_of_51_words(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(5)) for _ in range(n))
    passage = prose(51)
    assert len(passage) < 400
    df = spark.createDataFrame([(i, f"{prose(60)} {passage} {prose(60)}", "en", "s", 9) for i in range(2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(passage not in r.text for r in corpus_pipeline.suffix_dedup_stage(spark, df, "").collect())
