import collections
import hashlib
import random

import pytest

from orbweaver.llm import parsing, repeats


def slow(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(100), prose(300)
    texts = [prose(rng.randrange(1, 300)) for _ in range(10)]
    texts += [prose(20) + passage + prose(30), prose(7) + " " + passage, passage[: len(passage) // 2] + prose(40), other, other, other[50:900] + prose(10)]
    words = other.split()
    for k in (20, 50, 70, 90):
        copy = list(words)
        for i in range(k // 2, len(copy), k):
            copy[i] = "zz"
        texts.append(" ".join(copy))
    texts += ["a" * 5000, "ab" * 900, "x" + "a" * 399, "a" * 399, "a" * 400 + "y", None, "", prose(60) * 3, passage.encode()[5:410].decode("utf-8", "ignore")]
    x = prose(200).encode()
    texts += [(x[:401] + b"!").decode("utf-8", "ignore"), (b"?" + x[:400]).decode("utf-8", "ignore"), x[1:401].decode("utf-8", "ignore")]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    texts = sample(seed)
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tid string")
    got = {r.doc_id or 0: tuple(r)[1:] for r in repeats.repeats_report(df).collect()}
    want = slow(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i][:60] if texts[i] else texts[i])
    left = {r.doc_id or 0: r.text for r in repeats.remove_repeats(df).collect()}
    for i, t in enumerate(texts):
        if not want[i][1]:
            assert left[i] == t
        elif t.isascii():
            assert hashlib.sha256(left[i].encode()).hexdigest() == want[i][3]


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rng = random.Random(4)
    data = bytes(rng.randrange(97, 123) for _ in range(20000))
    rows = sorted((int(a), int(b)) for _, _, f, e, _ in repeats.zones([data], 400) for a, b in zip(f, e, strict=True))
    at = 0
    for a, b in rows:
        assert a == at
        at = b + 1
    assert at == len(data) - 399


def test_hashes_and_argmin():
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 500).astype(np.uint8)
    h = parsing.Hashes(data)
    a = h.of(np.arange(490), 8)
    text = data.tobytes()
    same = {}
    for i in range(490):
        same.setdefault(text[i : i + 8], set()).add(int(a[i]))
    assert all(len(v) == 1 for v in same.values()) and len(set.union(*same.values())) == len(same)
    v = rng.integers(0, 50, 300).astype(np.uint64) << np.uint64(40)
    got = parsing.sliding_argmin(v, 17)
    assert got.tolist() == [min(range(i, min(300, i + 17)), key=lambda k: (int(v[k]), k)) for i in range(300)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert repeats.repeats_report(df).count() == 0
    assert repeats.remove_repeats(df, size_col="n_chars").count() == 0


def test_query_against_brute_force(spark):
    from orbweaver.llm.queries import op2_suffix_dedup

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op2_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    for r, w in zip(rows, slow([r.text for r in rows]), strict=True):
        assert got[r.doc_id] == w
