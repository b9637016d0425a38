"""Sentences as units: the pieces are the whole text, and earlier ones of enough words go."""

import duckdb

from orbweaver.llm import units
from orbweaver.llm.queries import ORACLES, op6_sentence_dedup

SF = "/root/testdata/sf0.001"


def test_small(spark):
    long = "One two three four. "
    rows = [(1, f"{long}Five?! Six\n{long}"), (2, f"x. {long.upper()}End"), (3, None), (4, "...\n\n"), (None, long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")
    got = {r.doc_id: (r.n_units, [tuple(x) for x in r.removed], r.kept_text) for r in units.dedup_units(df, by="sentence", min_words=4).collect()}
    assert got == {
        1: (6, [(31, 19)], f"{long}Five?! Six\n "), 2: (3, [(2, 20)], "x. End"), 3: (0, [], ""), 4: (5, [], "...\n\n"), None: (2, [(0, 19)], " "),
    }


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = op6_sentence_dedup(spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op6_sentence_dedup']}) ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, df.collect())) == want and any(r[2] for r in want)
