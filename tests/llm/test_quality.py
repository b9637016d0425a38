import random

from pyspark.sql import functions as F

from orbweaver.llm import quality


def rows(n=300):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(20, 120))]
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        if toxic:
            text[3] = text[-2] = "nasty"
        text = " ".join(text)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join([text.split()[0]] * 80)
        docs.append((i, text, "en", f"src{i % 3}", len(text), "x"))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, None, None, None, None), (1001, "", "en", "s", 0, "x"), (1002, "plain words here " * 9000, "en", "s", 1, "x"), (None, "plain words without an id", "en", "s", 1, "x"), (5, docs[5][1], "en", "src2", 1, "again")]
    return docs, [*labels, (1, None, None), (None, 1, 0), (2, 1, 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def test_small(spark):
    docs, labels = rows()
    d = spark.createDataFrame(docs, SCHEMA)
    got = quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(300) if i % 3 == 0]
    text = {r[0]: r[1] for r in docs}
    junk = lambda t: "!!" in t or len(set(t.split())) == 1
    wrong = sum((by[i].quality_score >= 0.5) == junk(text[i]) for i in held) + sum((by[i].toxic_score >= 0.5) != ("nasty" in text[i].lower()) for i in held if not junk(text[i]))
    assert wrong <= 4
    assert by[1000].keep is False and by[1001].keep is False and by[None].quality_score > 0
    kept = quality.keep_good(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)


def test_no_labels_keeps_all_with_words(spark):
    docs, labels = rows(30)
    d = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(d, none).count() == len(docs) - 2
    assert quality.classify(d.limit(0), none).count() == 0
    assert quality.classify(d.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(docs)


def test_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = F.pmod(F.hash("doc_id"), F.lit(4)) > 0
    got = quality.classify(d, lab.filter(train)).join(lab.filter(~train), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.toxic]
    assert sum(r.keep for r in good) >= 0.98 * len(good)
    bad = [r for r in got if r.quality == 0]
    assert sum(not r.keep for r in bad) >= 0.95 * len(bad)
    toxic = [r for r in got if r.toxic]
    assert sum(not r.keep for r in toxic) >= 0.85 * len(toxic)
