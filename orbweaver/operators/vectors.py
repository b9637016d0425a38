"""Vector similarity: normalisation, cosine and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, in doubles, summed from the left."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v scaled to length one; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, unequal lengths or a zero vector."""
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to ``query`` by cosine, ties to the smaller id.

    The query is a literal, so its norm folds into a constant; each task keeps its own k rows
    (TakeOrderedAndProject), and nothing else is shuffled.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def nearest_to(vectors: DataFrame, query_id: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to the row ``query_id``, itself included; the one query row is joined in."""
    q = vectors.filter(F.col(id_col) == query_id).select(F.col(vector_col).alias("q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(q))  # one row
    return scored.select(id_col, F.round(cosine(F.col(vector_col), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
