import zlib

from pyspark.sql import functions as F

from orbweaver.llm import langid

EN = "the cat and the dog are running through this house with their friends"
DE = "der hund und die katze laufen durch dieses haus mit ihren freunden über"


def rows():
    out = [(i, (EN, DE)[i % 2], ("en", "de")[i % 2], "x") for i in range(60)]
    return out + [(100, None, "en", None), (101, "", "de", ""), (102, "123 !!", "en", "n"), (103, EN, None, "l"), (None, DE, "de", "i"), (104, "the " * 60000, "en", "long"), (0, EN, "en", "again"), (105, "freundlich", None, "q"), (106, "日本", None, "q")]


def test_small(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for i in range(60):
        assert by[i].lang_pred == ("en", "de")[i % 2]
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "en" and by[104].lang_pred == "en" and by[105].lang_pred == "de"
    assert by[None].held_out is False and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score string")
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    from orbweaver.llm.queries import op5_language_id

    got = op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
