"""Keyword index and search."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_\-]+"

#: English function words that a query drops, by kind.
_FUNCTION_WORDS = {
    "pronouns": "i me my it its itself he him his she her hers we us our ours you your yours they them their theirs",
    "pointers": "this that these those here there the a an any each few some such other same own",
    "questions": "what which who whom where when why how",
    "forms of be, do, have": "be am is are was were been being do does did doing have has had having",
    "modals": "can could may should will would",
    "links": "and but or nor if so than then because as while until not no",
    "places": "in into on off over under up down above below between through to from of at by for with about after before during against out",
    "degrees": "all also again both further just more most very too only once now",
}
STOPWORDS = frozenset(w for ws in _FUNCTION_WORDS.values() for w in ws.split()) - {"us", "may", "against"}


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def tokens(text: Column) -> Column:
    """Lower-cased retrieval tokens of a text, in order, repeats kept."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Ordered distinct terms of a query without stopwords."""
    return [t for t in dict.fromkeys(x.lower() for x in re.findall(TOKEN, query)) if t not in STOPWORDS]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, id, tf): the inverted index as a table. Null texts have no tokens."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("token")).groupBy("token", id_col).agg(F.count("*").alias("tf"))


def keyword_search(docs: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents by matched share of the query's IDF mass; ties by term frequency, then id.

    The query's terms are known on the driver, so their filter stands below the aggregation: only
    postings of those terms are counted and shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("tf_sum"), F.lit(0).cast("long").alias("matched")).limit(0)
    post = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("token")).filter(F.col("token").isin(terms))
    post = post.groupBy(id_col).agg(*[F.count(F.when(F.col("token") == t, 1)).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = post.agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    n = docs.agg(F.count("*").alias("n"))
    idf = n.crossJoin(stats).select(*[F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)).alias(f"idf{i}") for i in range(len(terms))])
    total = sum((F.col(f"idf{i}") for i in range(len(terms))), F.lit(0.0))
    hit = lambda i: F.col(f"tf{i}") > 0
    score = sum((F.when(hit(i), F.col(f"idf{i}")).otherwise(0.0) for i in range(len(terms))), F.lit(0.0)) / total
    return (
        post.crossJoin(F.broadcast(idf))  # one row
        .select(
            id_col,
            F.round(score, 6).alias("score"),
            sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)).cast("long").alias("tf_sum"),
            sum((hit(i).cast("long") for i in range(len(terms))), F.lit(0)).cast("long").alias("matched"),
        )
        .orderBy(F.desc("score"), F.desc("tf_sum"), id_col)
        .limit(k)
    )
