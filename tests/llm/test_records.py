import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from orbweaver.llm import records
from orbweaver.session import scratch_path

PATH = P.path("byte_bpe_50k.json")


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ 0x82F63B78 * (crc & 1)
    return crc ^ 0xFFFFFFFF


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_crc32c():
    rng = random.Random(5)
    items = [b"123456789", *(rng.randbytes(n) for n in (4, 63, 64, 65, 127, 128, 129, 1000, 5000))]
    assert records.crc32c(items).tolist() == [slow_crc32c(x) for x in items]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283


def test_memo_equals_library(tokenizer):
    rng = random.Random(6)
    memo = records.WordMemo(PATH, most=5)
    alphabet = ["a", "bc", " ", "  ", "\n", "'re", "12", "é", "日本", "...", "\t", " ", " ", "\x1c", "\x85", "🙂", "²", "x²", "ŉ", "_", "d'", "ab.\nCd", ",\n", "e\u0301", "###", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    for at in range(0, 300, 50):
        part = texts[at : at + 50]
        got = [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode(part)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]


def check(spark, rows, tokenizer, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = scratch_path(spark, "records")
    manifest = records.write_records(df, path, PATH, end_id=2, shards=shards)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in records.read_records(spark, path, manifest).collect()), key=lambda x: x[1])
    want, at = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    return path


def test_files(spark, tokenizer):
    rows = [(i, f"text number {i} " * (i % 5), "x") for i in range(60)] + [(70, None, None), (71, "", "e"), (72, "long " * 30000, "l"), (None, "no id", "n"), (5, "text number 5 " * 0, "again")]
    path = check(spark, rows, tokenizer, 3)
    doc, ids = records.read_at(path, 0, 0)
    assert doc == -(1 << 63) and ids.tolist() == [*tokenizer.encode("no id", add_special_tokens=False).ids, 2]
    check(spark, [], tokenizer, 2)


def test_damage_is_found(spark, tokenizer):
    path = check(spark, [(i, "some words " * 20, None) for i in range(10)], tokenizer, 1)
    local = path.removeprefix("file:")
    while local.startswith("//"):
        local = local[1:]
    name = f"{local}/shard-000000.rec"
    data = bytearray(open(name, "rb").read())
    data[40] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError):
        list(records._read_shard(path, 0))


def test_query_against_library(spark, tokenizer):
    from orbweaver.llm.queries import op4_token_records

    got = {r.doc_id: r for r in op4_token_records(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
