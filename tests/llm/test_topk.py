import math
import random

from pyspark.sql import functions as F

from orbweaver.llm import topk


def slow(rows, is_query, k=5):
    def vec(v):
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    ok = [(i, vec(v)) for i, v in rows if i is not None and vec(v) is not None]
    out = []
    for i, q in ok:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return sorted(map(tuple, topk.top_k(v.filter("vec_id % 50 = 0"), v, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0, 0.126, 0.0]) for _ in range(6)]) for i in range(300)]
    rows += [(301, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1e6] * 6), (None, [1.0] * 6), (400, [0.5, 0.5])]
    assert run(spark, rows) == slow(rows, lambda i: i % 50 == 0)


def test_fewer_than_k_ties_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 0.0])]
    assert run(spark, rows) == slow(rows, lambda i: i % 50 == 0)
    same = [(i, [0.5, 0.5]) for i in range(120)]
    assert run(spark, same) == slow(same, lambda i: i % 50 == 0)
    assert run(spark, []) == []
