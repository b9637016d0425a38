import numpy as np
import pytest
import xxhash

from orbweaver.llm import simhash
from orbweaver.llm.components import components


def slow_fingerprint(text):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for b in range(64):
        if sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) * 2 > len(grams) > 0:
            out |= 1 << b
    return out


def slow_components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t", "one", "Two words", "a b c", "Ä b c d É e", "The cat sat. " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_keys_meet_at_three_bits():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for places in ([], [0], [63], [0, 1, 2], [22, 23, 24], [43, 44, 45], [5, 30, 60], [1, 2, 50], [30, 31, 63]):
        g = f.copy()
        for b in places:
            g ^= np.uint64(1 << b)
        (ra, ka), (rb, kb) = simhash.bucket_keys(f), simhash.bucket_keys(g)
        for i in range(len(f)):
            assert set(ka[ra == i]) & set(kb[rb == i])


@pytest.mark.parametrize("small,large", [(24, 4096), (2, 8), (1, 2)])
def test_bucket_links_connect_all(small, large):
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    rows, keys = simhash.bucket_keys(fps)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.bucket_links(keys[order], fps[rows][order], 3, small, large)
    assert all(int(x ^ y).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    label = {int(f): i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a, b, strict=True):
        p, q = root(label[int(x)]), root(label[int(y)])
        parent[max(p, q)] = min(p, q)
    assert [root(i) for i in range(len(fps))] == slow_components([int(f) for f in fps])


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base.replace(f"w{i * 7} ", "zz ") if i else base, "x") for i in range(12)]
    rows += [(100, base, "y"), (101, base, None), (102, None, "n"), (103, "", "e"), (104, "lone", "l"), (None, base, "q"), (105, "word " * 20000, "long"), (105, "word " * 20000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # a clashing name
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(r[1]) for r in rows]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1)) for r in got) == sorted((r[0] if r[0] is not None else -1, f) for r, f in zip(rows, fps, strict=True))
    label = slow_components(fps)
    want = {}
    for i, (r, c) in enumerate(zip(rows, label, strict=True)):
        want[r[0]] = min(rows[j][0] for j in range(len(rows)) if label[j] == c and rows[j][0] is not None)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert set(kept[0].asDict()) == {"doc_id", "text", "fp"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_query_against_brute_force(spark):
    from orbweaver.llm.queries import op1_simhash_near_dedup

    got = {r.doc_id: r for r in op1_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [simhash.fingerprint(r.text) for r in rows]
    label = slow_components(fps)
    for r, f, c in zip(rows, fps, label, strict=True):
        assert got[r.doc_id].fingerprint == f"{f:016x}"
        assert got[r.doc_id].component_id == rows[c].doc_id
