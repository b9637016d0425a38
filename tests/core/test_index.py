"""The index on disk, context thresholds with their fallback, and actions that are tried again."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweaver.client import Client
from orbweaver.streaming import monitor


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Wind turbines need an oil change by Ann Lee."), (2, "The invoice of March was paid late."), (3, "Password audits happen every year.")], "doc_id long, text string")
    c = Client(spark)
    c.index(c.process(docs))
    path = str(tmp_path / "index")
    c.save(path)
    again = Client.load(spark, path)
    assert again.search("turbines oil", 2).collect() == c.search("turbines oil", 2).collect()
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    assert read("frequencies").filter("token = 'the'").first().df == 1
    assert {"document:1:0", "entity:Ann Lee", "parent:1"} <= {r.node for r in read("nodes").collect()}
    assert read("edges").filter("rel = 'PART_OF'").count() == 3
    length = read("chunks").select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("n"))
    assert all(abs(r.n - 1) < 1e-9 for r in length.collect())


def test_contexts_fall_back_to_overlap(spark):
    docs = spark.createDataFrame([(1, "Wind turbines need an oil change."), (2, "The invoice was paid.")], "doc_id long, text string")
    c = Client(spark)
    c.index(c.process(docs))
    assert c.contexts("turbines oil", 1).first().doc_id == 1
    assert [r.doc_id for r in c.contexts("turbines oil", 2, least_score=2.0).collect()] == [1]
    assert c.contexts("nothing alike", 2, least_score=2.0).count() == 0


def test_pending_actions_are_tried_again(spark, tmp_path):
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])
    box, at = str(tmp_path / "box"), str(tmp_path / "at")
    folder = tmp_path / "in"
    folder.mkdir()
    answers = str(tmp_path / "ready")

    def send(row):
        import os

        return "failed" if row["key"] == "c" else "sent" if row["key"] == "a" or os.path.exists(answers) else "retry"

    def run(n, rows):
        (folder / f"{n}.json").write_text("\n".join(f'{{"key": "{k}", "n": {n}}}' for k in rows))
        q = monitor.dispatch(monitor.replay(spark, str(folder), schema), send, box, at)
        q.awaitTermination()
        return {(r.key, r.status, r.batch) for r in spark.read.parquet(box).collect()}

    assert run(0, "aabc") == {("a", "sent", 0), ("b", "pending", 0), ("c", "failed", 0)}
    open(answers, "w").close()
    assert run(1, "acd") == {("a", "sent", 0), ("b", "pending", 0), ("c", "failed", 0), ("b", "sent", 1), ("d", "sent", 1)}
