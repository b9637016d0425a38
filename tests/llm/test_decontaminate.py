import hashlib
import re

import pytest
from pyspark.sql import functions as F

from orbweaver.llm import decontaminate


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow(docs, items, size=8):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def slow_clean(docs, items, size=8):
    whole = {tuple(w[i : i + size]) for w in (words(t) for _, t in items) for i in range(len(w) - size + 1)}
    has = lambda w: any(tuple(w[i : i + size]) in whole for i in range(len(w) - size + 1))
    many = {d for d, *_, bad in slow(docs, items, size) if bad}
    return {d for d, t in docs if d not in many and not has(words(t))}


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "short item"), (10, "a b c d e f g h i j"), (3, None), (4, "..."), (5, "a b c d e f g h i j"), (6, "x x x x x x x x x x")]
DOCS = [
    (1, "see: THE quick, brown fox-jumps over the lazy dog again... and a short item"),
    (2, None),
    (3, ""),
    (4, "x " * 30),
    (5, "a b c d e f g h a b c d e f g h i j"),
    (6, "nothing of the kind, Ünïcode fox"),
    (7, "word " * 50000 + "short item"),
    (7, "word " * 50000 + "short item"),
    (None, "short item"),
    (8, "a b c d e f g"),
]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_small(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, item_id string, start int")
    items = spark.createDataFrame([(*i, 2) for i in ITEMS], "item_id int, text string, doc_id int")
    got = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str)
    assert got == sorted(slow(DOCS, ITEMS), key=str)
    left = {r.doc_id for r in decontaminate.clean(docs, items).collect()}
    assert left == slow_clean(DOCS, ITEMS)


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {tuple(r)[2:4] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {(0, 0)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "dog lazy the near a brown fox"), (2, "fox " + "z " * 40 + "brown lazy dog")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "brown fox lazy dog")], "item_id int, text string")
    assert {r.key for r in decontaminate.proximity(docs, items, within=8).collect()} == {1}


def test_query_against_brute_force(spark):
    from orbweaver.llm.queries import op10_benchmark_decontamination

    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()]
    got = sorted(tuple(r) for r in op10_benchmark_decontamination(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(slow(read("documents"), read("benchmark")))
    assert any(r[3] for r in got)


def test_stored_words_come_in_small_row_groups(spark):
    """A task that writes or reads the index holds a few MB of it, whether texts are many or long."""
    import pyarrow.parquet as pq

    def texts(n, size):
        one = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.hex(F.xxhash64("id", i))), " ")
        return spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(one, F.lit(" short item")).alias("text"))

    for n, size in ((2000, 800), (30, 60000)):
        index = decontaminate._Index(texts(n, size), "doc_id", "text")
        try:
            assert index.words.agg(F.sum(F.size("ws"))).first()[0] == n * (size + 2)
            files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.words.inputFiles()]
            groups = [sum(m.row_group(k).column(c).total_compressed_size for c in range(m.num_columns)) for m in files for k in range(m.num_row_groups)]
            assert sum(groups) > 10e6 and max(groups) < 4e6
        finally:
            index.drop()
        items = spark.createDataFrame([(1, "short item")], "item_id int, text string")
        assert {tuple(r)[1:4] for r in decontaminate.contamination(texts(n, size), items).collect()} == {(size + 2, 2, 1)}
