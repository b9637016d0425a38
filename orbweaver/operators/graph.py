"""Property graph of documents: parents, entities and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure_list(value: Column) -> Column:
    """Null as an empty list, a scalar as a list of one."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def edges(docs: DataFrame, id_col: str = "doc_id", parent: str | None = None, entities: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """(src, rel, dst) of each document: PART_OF its parent, MENTIONS entities, TAGGED_AS tags.

    Fields are strings or arrays of strings; nulls make no edge. One pass over the documents.
    """
    kinds = dict(docs.dtypes)

    def items(field: str, rel: str, prefix: str) -> Column:
        c = F.col(field) if kinds[field].startswith("array") else ensure_list(F.col(field))
        c = F.coalesce(c, F.array().cast("array<string>"))
        return F.transform(c, lambda v: F.struct(F.lit(rel).alias("rel"), F.concat(F.lit(f"{prefix}:"), v.cast("string")).alias("dst")))

    parts = [items(parent, "PART_OF", "parent")] if parent else []
    parts += [items(f, "MENTIONS", "entity") for f in entities or []] + [items(f, "TAGGED_AS", "tag") for f in tags or []]
    found = docs.select(F.concat(F.lit("document:"), F.col(id_col).cast("string")).alias("src"), F.explode(F.concat(*parts)).alias("e"))
    return found.select("src", F.col("e.rel").alias("rel"), F.col("e.dst").alias("dst")).filter("dst IS NOT NULL")


def nodes(edge_table: DataFrame) -> DataFrame:
    """(node, kind, value) of all ends of the edges."""
    ends = edge_table.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.select("node", F.substring_index("node", ":", 1).alias("kind"), F.expr("substring(node, instr(node, ':') + 1)").alias("value"))


def adjacency(edge_table: DataFrame) -> DataFrame:
    """(node, neighbour), both ways, each pair once."""
    both = edge_table.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour")))).alias("p"))
    return both.select("p.*").distinct()


def score(edge_table: DataFrame, terms: list[str]) -> DataFrame:
    """(src, graph_score): the share of a document's distinct neighbours whose kind or value holds a term."""
    text = F.concat_ws(" ", F.substring_index("dst", ":", 1), F.lower(F.expr("substring(dst, instr(dst, ':') + 1)")))
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(text, t)) if terms else F.lit(False)
    return edge_table.select("src", "dst").distinct().groupBy("src").agg(F.avg(hit.cast("double")).alias("graph_score"))
