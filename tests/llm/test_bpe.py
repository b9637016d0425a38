import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from orbweaver.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (40, 12), (64, 1)])
def test_chunks_equal_whole(whole, chunk, overlap):
    table = bpe.ChunkedBpe(PATH, P.PATTERN, chunk, overlap)
    rng = random.Random(3)
    alphabet = ["a", "bc", " ", "  ", "\n", "'re", "'", "r", "12", "é", "日本", "...", "\t", " ", "x" * 50, " " * 40, "🙂"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
        assert "".join(table.pieces(text)) == text
        assert table.encode(text) == whole.encode_ordinary(text)
        assert table.decode(table.encode(text)) == text.encode()


def test_documents(spark, whole):
    texts = ["plain text here", None, "", "long words and more of them. " * 9000, "<|endoftext|>", "naïve 日本語 🙂"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.round_trip(df, PATH, P.PATTERN).collect()}
    assert len(got) == 7
    for i, t in enumerate([*texts, texts[0]]):
        ids = whole.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.data) for r in back} == {i: (t or "").encode() for i, t in enumerate([*texts, texts[0]])}
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query_against_whole_texts(spark, whole):
    from orbweaver.llm.queries import op3_byte_bpe

    got = {r.doc_id: r for r in op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = whole.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
