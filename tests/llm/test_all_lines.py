from test_units import slow

from orbweaver.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_short_lines_count(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, cut = slow(docs, "line", 1), slow(docs, "line", 5)
    got = {r.doc_id: r for r in QUERIES["op6_line_dedup_all"](spark, SF).collect()}
    for i, (units, gone, places, kept) in want.items():
        assert (got[i].n_units, got[i].n_removed, got[i].kept_text) == (units, gone, kept)
        assert got[i].removed == ",".join(f"{a}:{b}" for a, b in places)
    assert sum(w[1] for w in want.values()) > sum(w[1] for w in cut.values())
