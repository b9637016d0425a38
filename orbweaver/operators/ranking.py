"""Fusion of ranked lists, hybrid search and set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse(semantic: DataFrame, lexical: DataFrame, graph: DataFrame, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), k: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Weighted mean of the three scores over the union of both candidate lists, ties to the smaller id.

    Candidates are (id, semantic_score) and (id, lexical_score); graph scores (id, graph_score) are
    only looked up. A missing score is 0. The weights' sum divides.
    """
    ws, wl, wg = (float(w) for w in weights)
    both = semantic.join(lexical, id_col, "full_outer").join(graph, id_col, "left")
    s, x, g = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("semantic_score", "lexical_score", "graph_score"))
    total = (F.lit(ws) * s + F.lit(wl) * x + F.lit(wg) * g) / (ws + wl + wg)
    return both.select(id_col, s.alias("semantic_score"), x.alias("lexical_score"), g.alias("graph_score"), F.round(total, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens of two sets over the root of the product of their sizes; 0 if either is empty."""
    n = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)).cast("double") / F.size(query))


def blended(query: Column, text: Column) -> Column:
    """0.65 overlap and 0.35 coverage."""
    return F.lit(0.65) * overlap(query, text) + F.lit(0.35) * coverage(query, text)


def rerank_score(logit: Column) -> Column:
    """A cross-encoder's logit as a share."""
    return 1 / (1 + F.exp(-logit))
