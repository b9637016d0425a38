import re

from orbweaver import catalog
from orbweaver.operators import enrich

TEXTS = ["Zoé met Anna Lee", "Éva and Karl", "Müller, Hans\u00a0Meier in Köln", "Ana y José Luna", "plain Text", "", None]


def test_entities_of_every_text(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
        want = {r.doc_id: len(set(re.findall(enrich.ENTITY, r.text or ""))) for r in docs}
        got = {r.doc_id: r.n_entities for r in catalog.QUERIES["entity_counts_all"](spark, sf).collect()}
        assert got == want
