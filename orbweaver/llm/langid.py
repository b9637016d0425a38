"""Language identification: known words first, then ever shorter character n-grams.

The model holds, for each language seen in the learning rows, the log frequency of its words and of
the n-grams (5 down to 1 characters, word ends marked) of its words. A word that is known
adds its log frequencies; an unseen word adds the mean over its longest n-grams of which any is known.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.session import cut

#: The model learns from about this many labelled documents a language, chosen by a hash of their id.
LEARN_DOCS = 1500
#: The frequency of what a language was never seen to have, the same for all however much each had. What is
#: less than twice as frequent tells nothing of a language: it is left out, and words back off to n-grams.
FLOOR = 1e-6
ORDERS = (5, 4, 3, 2, 1)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its end marks (for n = 1, of its letters)."""
    if n == 1:
        return list(word)
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies: tables[0] by word, tables[n] by n-gram; each row has a number a language."""

    languages: list[str]
    tables: dict[int, dict[str, int]]
    logs: np.ndarray
    memo: dict[str, np.ndarray | None] = field(default_factory=dict, repr=False)

    def vector(self, word: str) -> np.ndarray | None:
        """What an unseen word adds: from its longest known n-grams; None where no character is known."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 50_000:
            self.memo.clear()
        out = None
        for n in ORDERS:
            table = self.tables.get(n, {})
            rows = [table[g] for g in grams(word, n) if g in table]
            if rows:
                out = self.logs[rows].mean(0)
                break
        self.memo[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the most likely language, ties to the first by name, and its share.

        ``und`` with score 0 where there is no letter or no language was learnt.
        """
        found = words(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        known = self.tables.get(0, {})
        rows, total, n = [], np.zeros(len(self.languages)), 0
        for w in found:
            if (r := known.get(w)) is not None:
                rows.append(r)
            elif (v := self.vector(w)) is not None:
                total = total + v
                n += 1
        if rows:
            total = total + np.bincount(np.array(rows), minlength=len(self.logs)) @ self.logs if len(rows) > 20_000 else total + self.logs[rows].sum(0)
            n += len(rows)
        if not n:
            return self.languages[0], 1.0 / len(self.languages)
        e = np.exp((total - total.max()) / np.sqrt(n))
        return self.languages[int(np.argmax(total))], float(e.max() / e.sum())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from rows with a text and a language.

    The sample of labelled rows is bounded (LEARN_DOCS a language, by id hash), every language takes
    part, counting is distributed, and the tables that come to the driver hold what the sample has.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], {}, np.zeros((0, 0)))
    share = {r["lang"]: min(1.0, LEARN_DOCS / r["n"]) for r in sizes}
    bound = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 30))))])
    sample = rows.filter(F.pmod(F.xxhash64(F.col("id"), F.lit("learn")), F.lit(1 << 30)) < bound[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(seen: dict[str, Counter]) -> Iterator[pd.DataFrame]:
            for lang, c in seen.items():
                if c:
                    yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

        seen: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, seen.values())) > 300_000:
                yield from flush(seen)
                seen = {}
        yield from flush(seen)

    by_word = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for lang, word, n in pdf.itertuples(index=False):
                c[lang, 0, word] += n
                for order in ORDERS:
                    for g in grams(word, order):
                        c[lang, order, g] += n
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["lang", "kind", "item", "n"])

    items = by_word.mapInPandas(cut_up, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    items = cut(items)
    sums = items.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    top = items.join(F.broadcast(sums), ["lang", "kind"]).filter(F.col("n") >= 2 * FLOOR * F.col("total")).select("lang", "kind", "item", "n", "total").toPandas()  # sums: six rows a language
    index = {x: i for i, x in enumerate(languages)}
    keys = sorted(set(zip(top["kind"], top["item"], strict=True)))
    where = {k: i for i, k in enumerate(keys)}
    counts = np.zeros((len(keys), len(languages)))
    totals = np.ones((6, len(languages)))
    for lang, kind, item, n, t in top.itertuples(index=False):
        counts[where[kind, item], index[lang]] = n
        totals[kind, index[lang]] = t
    kinds = np.array([k for k, _ in keys])
    logs = np.log(counts / totals[kinds] + FLOOR).astype(np.float32)
    tables: dict[int, dict[str, int]] = {}
    for (kind, item), i in where.items():
        tables.setdefault(int(kind), {})[item] = i
    return Model(languages, tables, logs)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEARN_DOCS a language

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("__p", of(F.col(text_col))).withColumn("lang_pred", F.col("__p.lang_pred")).withColumn("score", F.col("__p.score")).drop("__p")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: id, held_out, lang_pred, score.

    Learns from rows that are not held out and have a language; predictions look at texts only.
    Null texts and texts without letters are ``und`` with score 0; repeated rows stay; with nothing to
    learn from every row is ``und``. Texts of any length are read whole; an empty table gives no rows.
    Other columns do no harm.
    """
    model = fit(docs.filter(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    base = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(base, model, "__text").drop("__text")
