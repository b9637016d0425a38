"""Both views pass labels to each other, and that costs no accuracy."""

from pyspark.sql import functions as F
from test_quality import SCHEMA, rows

from orbweaver.llm import quality

SF = "/root/testdata/sf0.1"


def test_both_views_give_in_each_round(spark):
    docs, labels = rows()
    d = spark.createDataFrame(docs, SCHEMA)
    model = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {p[:3] for p in model.passed} == {(t, r, v) for t in quality.TARGETS for r in range(quality.ROUNDS) for v in ("text", "metadata")}
    unlabelled = sum(1 for r in docs if r[0] not in {x[0] for x in labels if x[0] is not None} and r[1])
    assert all(p[3] > 0 and p[4] > 0 and p[3] + p[4] <= unlabelled for p in model.passed)


def test_exchange_changes_both_views_and_keeps_accuracy(spark):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = F.pmod(F.hash("doc_id"), F.lit(4)) > 0
    models = {n: quality.fit(d, lab.filter(train), rounds=n) for n in (0, quality.ROUNDS)}
    held = d.join(lab.filter(~train), "doc_id")
    right = {}
    for n, m in models.items():
        got = quality.score(held.drop("quality", "toxic"), m).join(lab, "doc_id").collect()
        right[n] = sum((r.quality_score >= 0.5) == bool(r.quality) for r in got) + sum((r.toxic_score >= 0.5) == bool(r.toxic) for r in got)
    assert right[quality.ROUNDS] >= 0.998 * right[0]
    for t in quality.TARGETS:
        a, b = models[0].views[t], models[quality.ROUNDS].views[t]
        assert abs(a.text - b.text).max() > 1e-3 and abs(a.meta - b.meta).max() > 1e-3
    print(right)
