"""Reply intents: weighted patterns, and a naive Bayes model that learns from labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweaver.session import cut as cut_rows

SIGNALS = ("stop_contact", "callback_request")
COMPATIBLE = ({"mandate_issue", "promise_to_pay"},)
#: A small default lexicon: intent to (pattern, weight); jobs give their own.
LEXICON = {
    "promise_to_pay": [(r"\b(?:will|shall|going to)\s+(?:pay|clear|transfer)", 0.75), (r"\bpay\s+(?:by|on|before|tomorrow|today)\b", 0.7)],
    "hardship": [(r"\b(?:unable|not able)\s+to\s+pay\b", 0.7), (r"\blo(?:st|sing)\s+my\s+(?:job|work)\b", 0.9)],
    "already_paid": [(r"\b(?:paid|transferred)\b", 0.55), (r"\balready\s+(?:cleared|paid)\b", 0.9)],
    "dispute": [(r"\b(?:wrong|double|extra)\s+(?:charge|amount|debit)", 0.8), (r"\bcomplaint\b", 0.7)],
    "stop_contact": [(r"\A\s*stop\s*\Z", 0.95), (r"\bunsubscribe\b", 0.9)],
    "wrong_number": [(r"\bwrong\s+(?:person|number)\b", 0.95)],
    "callback_request": [(r"\bcall\s+me\s+(?:back|later)\b", 0.8)],
}


def lexicon_scores(text: Column, lexicon: dict[str, list[tuple[str, float]]] | None = None) -> Column:
    """(intent, score) of every intent: 1 less the product of 1 - weight over its matching patterns."""
    low = F.left(F.coalesce(text, F.lit("")), F.lit(2000))
    rows = []
    for intent, patterns in (lexicon or LEXICON).items():
        miss = reduce(lambda a, b: a * b, [F.when(F.rlike(low, F.lit(f"(?iu){p}")), 1 - w).otherwise(1.0) for p, w in patterns])
        rows.append(F.struct(F.round(1 - miss, 4).alias("score"), F.lit(intent).alias("intent")))
    return F.array(*rows)


def classify(df: DataFrame, text: str = "text", lexicon: dict[str, list[tuple[str, float]]] | None = None, review_below: float = 0.6) -> DataFrame:
    """``df`` with intent, confidence, needs_review and the signals found beside it.

    The intent is the best substantive one with 0.5 or more, else a signal of 0.5 or more, else
    'other'. Its confidence is its score less half the best rival's; signals and compatible intents are
    no rivals.
    """
    d = df.withColumn("__s", lexicon_scores(F.col(text), lexicon))
    order = lambda xs: F.array_sort(xs, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["intent"] < b["intent"], -1).otherwise(1))
    real = order(F.filter("__s", lambda x: (x["score"] > 0) & ~x["intent"].isin(*SIGNALS)))
    signal = order(F.filter("__s", lambda x: (x["score"] >= 0.5) & x["intent"].isin(*SIGNALS)))
    d = d.withColumn("__r", real).withColumn("__g", signal).withColumn("__t", F.try_element_at("__r", F.lit(1)))
    d = d.withColumn("__p", F.when(F.col("__t.score") >= 0.5, F.col("__t")).otherwise(F.try_element_at("__g", F.lit(1))))
    rival = F.filter("__r", lambda x: (x["intent"] != F.col("__p.intent")) & ~reduce(lambda a, b: a | b, [x["intent"].isin(*p) & F.col("__p.intent").isin(*p) for p in COMPATIBLE]))
    best = F.coalesce(F.try_element_at(rival, F.lit(1))["score"], F.lit(0.0))
    conf = F.round(F.greatest(F.lit(0.0), F.col("__p.score") - 0.5 * best), 4)
    d = d.withColumn("intent", F.coalesce("__p.intent", F.lit("other"))).withColumn("confidence", F.coalesce(conf, F.lit(0.0)))
    return d.withColumn("needs_review", F.col("confidence") < review_below).withColumn("signals", F.transform("__g", lambda x: x["intent"])).drop("__s", "__r", "__g", "__t", "__p")


def entities(text: Column) -> dict[str, Column]:
    """payment_reference, amount and months_requested of a reply."""
    some = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return {
        "payment_reference": F.upper(some(r"(?i)\b(?:ref|rrn|txn|utr)\s*(?:id|no|number|)\s*[-#:]?\s*([0-9a-z]{8,})")),
        "amount": F.regexp_replace(some(r"(?i)(?:inr|rs[.]?|₹)\s*([,0-9]+(?:[.][0-9]{1,2})?)"), ",", "").try_cast("double"),
        "months_requested": some(r"(?i)\b(\d{1,2})\s+months?\b").try_cast("int"),
    }


_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DAYS = {d: i for i, d in enumerate("mon tue wed thu fri sat sun".split())}


def promise_date(text: str | None, today: date) -> date | None:
    """The day a reply promises: d/m[/y], d month, the nth, a relative day or a weekday, in this order."""
    t = (text or "").lower()

    def day(y: int, m: int, d: int) -> date | None:
        try:
            return date(y, m, d)
        except ValueError:
            return None

    if m := re.search(r"\b([0-9]{1,2})[/-]([0-9]{1,2})(?:[/-]([0-9]{2,4}))?\b", t):
        y = int(m[3]) + (2000 if len(m[3]) == 2 else 0) if m[3] else today.year
        if found := day(y, int(m[2]), int(m[1])):
            return found if m[3] or found >= today else day(y + 1, int(m[2]), int(m[1]))
    if (m := re.search(r"\b([0-9]{1,2})(?:th|rd|nd|st)?\s+(" + "|".join(_MONTHS) + r")[a-z]*\b", t)) and (found := day(today.year, _MONTHS[m[2]], int(m[1]))):
        return found if found >= today else day(today.year + 1, _MONTHS[m[2]], int(m[1]))
    if m := re.search(r"\b([0-9]{1,2})(?:th|rd|nd|st)\b", t):
        found = day(today.year, today.month, int(m[1]))
        if found and found >= today:
            return found
        return day(today.year + today.month // 12, today.month % 12 + 1, int(m[1]))
    for word, n in (("day after tomorrow", 2), ("tomorrow", 1), ("today", 0), ("next week", 7)):
        if word in t:
            return today + timedelta(days=n)
    if m := re.search(r"\b(" + "|".join(_DAYS) + r")\w*", t):
        return today + timedelta(days=(_DAYS[m[1]] - today.weekday() - 1) % 7 + 1)
    return None


def promised(text: Column, today: Column) -> Column:
    """promise_date of a column, in Arrow batches."""

    @F.pandas_udf("date")
    def run(texts: pd.Series, days: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or pd.isna(d) else promise_date(t, d) for t, d in zip(texts, days, strict=True)], dtype=object)

    return run(text, today.cast("date"))


_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> list[str]:
    """Words, and the 3- and 4-grams of words between their ends; numbers by their length."""
    out = []
    found = _WORD.findall(text.lower()) if text else []
    for w in found:
        w = "#" * min(6, len(w)) if w.isdigit() else w
        marked = f"<{w}>"
        out.append(f"w:{w}")
        out += [f"c:{marked[i : i + n]}" for n in (3, 4) for i in range(len(marked) - n + 1)]
    return out


def nb_counts(examples: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, feature, n, df): how often each class has each feature, and in how many examples."""
    kind = examples.schema[label].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, d = Counter(), Counter()
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                f = features(t)
                n.update((y, x) for x in f)
                d.update((y, x) for x in set(f))
            yield pd.DataFrame([(y, x, c, d[y, x]) for (y, x), c in n.items()], columns=["label", "feature", "n", "df"])

    rows = examples.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label")).mapInPandas(run, f"label {kind}, feature string, n long, df long")
    return rows.groupBy("label", "feature").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def nb_predict(examples: DataFrame, test: DataFrame, id_col: str, text: str = "text", label: str = "label", most: int = 20_000) -> DataFrame:
    """(id, label, probability) by multinomial naive Bayes over the ``most`` most common features, +1 smoothed.

    Fitting and prediction are joins and sums, so neither the texts nor the model pass the driver.
    Nothing is predicted with fewer than 2 classes or 10 examples.
    """
    counts = nb_counts(examples, text, label)
    vocabulary = counts.groupBy("feature").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "feature").limit(most).select("feature")
    kept = counts.join(vocabulary, "feature")
    classes = examples.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("docs"))
    totals = classes.crossJoin(F.broadcast(classes.agg(F.sum("docs").alias("all"), F.count("*").alias("k"))))
    size = vocabulary.agg(F.count("*").alias("size"))
    denom = kept.groupBy("label").agg(F.sum("n").alias("total"))
    prior = totals.filter("k >= 2 AND all >= 10").join(denom, "label", "left").crossJoin(F.broadcast(size)).select("label", F.log(F.col("docs") / F.col("all")).alias("prior"), (F.coalesce("total", F.lit(0)) + F.greatest("size", F.lit(1))).alias("denom"))
    kind = test.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, f, n) for i, t in zip(pdf["id"], pdf["text"], strict=True) for f, n in Counter(features(t)).items()], columns=["id", "feature", "times"])

    feats = test.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(cut, f"id {kind}, feature string, times long").join(vocabulary, "feature")
    seen = feats.join(kept.select("feature", "label", "n"), "feature").join(prior.select("label", "denom"), "label")
    gain = seen.groupBy("id", "label").agg(F.sum(F.col("times") * F.log(F.col("n") + 1)).alias("gain"))
    length = feats.groupBy("id").agg(F.sum("times").alias("len"))
    base = test.select(F.col(id_col).alias("id")).distinct().crossJoin(F.broadcast(prior))  # a row a class
    s = base.join(gain, ["id", "label"], "left").join(length, "id", "left")
    s = s.withColumn("log", F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.coalesce("len", F.lit(0)) * F.log("denom"))
    w = Window.partitionBy("id")
    s = s.withColumn("p", F.exp(F.col("log") - F.max("log").over(w))).withColumn("z", F.sum("p").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("log"), "label")))
    return s.filter("r = 1").select(F.col("id").alias(id_col), F.col("label").alias(label), F.round(F.col("p") / F.col("z"), 6).alias("probability"))


def fold(text: Column, k: int = 5) -> Column:
    """The fold of a text: SHA-256 of it as a number, modulo k (byte by byte, as it fits no type)."""
    digest = F.sha2(text.cast("binary"), 256)
    bytes_ = F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.conv(F.substring(digest, i, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(bytes_, F.lit(0), lambda s, b: (s * 256 + b) % k)


#: What is masked before a text leaves the process, in this order: later patterns are looser.
REDACTIONS = (
    (r"[\w+.-]+@[\w-]+\.[\w.-]+", "[email]"),
    (r"(?i)\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[pan]"),
    (r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b", "[id-number]"),
    (r"(?:\+?[0-9]{1,3}[\s-]?)?\b[6-9][0-9]{9}\b", "[phone]"),
    (r"\+?[0-9][0-9\s().-]{8,}[0-9]", "[number]"),
    (r"(?i)\b[A-Z0-9]*[0-9][A-Z0-9]{7,}\b", "[reference]"),
)


def redact(text: Column) -> Column:
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def evaluate_folds(examples: DataFrame, k: int = 5, text: str = "text", label: str = "label") -> DataFrame:
    """(label, predicted, n): the confusion of ``k`` models, each tested on the fold it was not fitted on.

    Folds follow from the texts alone; what a model can't predict is ``other``. Fewer than 10 examples give no rows.
    """
    rows = cut_rows(examples.filter(F.col(label).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(text).alias("text"), F.col(label).alias("label"), fold(F.col(text), k).alias("fold")).withColumn("row", F.monotonically_increasing_id()))
    parts = []
    for i in range(k):
        test = rows.filter(F.col("fold") == i)
        guess = nb_predict(rows.filter(F.col("fold") != i), test, "row").select("row", F.col("label").alias("predicted"))
        parts.append(test.join(guess, "row", "left").select("label", F.coalesce("predicted", F.lit("other")).alias("predicted")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    enough = rows.agg((F.count("*") >= 10).alias("enough"))
    return every.groupBy("label", "predicted").agg(F.count("*").alias("n")).crossJoin(F.broadcast(enough)).filter("enough").drop("enough")


def accuracy(confusion: DataFrame) -> DataFrame:
    """One row: examples and the share of them that is right."""
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    return confusion.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("examples"), F.round(right / F.sum("n"), 4).alias("accuracy"))


#: The most that a language model's answer is trusted.
MODEL_CONFIDENCE = 0.85


def model_answers(replies: DataFrame, ask: Callable[[str], dict | None], intents: list[str], review_below: float = 0.6, text: str = "text") -> DataFrame:
    """``replies`` (text, intent, confidence, needs_review) with a model's answer where they need review.

    The model sees redacted text only. An answer of no known intent, or none, leaves the reply as it was.
    """

    @F.pandas_udf("intent string, confidence double")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                a = ask(t) if t is not None else None
                c = min(MODEL_CONFIDENCE, max(0.0, float(a.get("confidence", 0)))) if isinstance(a, dict) and a.get("intent") in intents else None
            except Exception:  # an answer that can't be had must not stop the replies
                c = None
            out.append((a["intent"], round(c, 4)) if c is not None else (None, None))
        return pd.DataFrame(out, columns=["intent", "confidence"])

    a = replies.withColumn("__a", run(F.when(F.col("needs_review"), redact(F.col(text)))))
    got = F.col("__a.intent").isNotNull()
    a = a.withColumn("method", F.when(got, "model").otherwise("rules")).withColumn("intent", F.coalesce("__a.intent", "intent")).withColumn("confidence", F.coalesce("__a.confidence", "confidence"))
    return a.withColumn("needs_review", F.when(F.col("method") == "model", F.col("confidence") < review_below).otherwise(F.col("needs_review"))).drop("__a")
