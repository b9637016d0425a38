"""A facade: process documents, index them, search, ask. State is tables, so every step scales out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import access, chunking, enrich, graph, guardrails, lexical, ranking, vectors


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for an embedder: counts of hashed tokens, scaled to length one. It knows no meaning."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        import hashlib
        import math
        import re

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in re.findall(lexical.TOKEN, t or ""):
                h = int.from_bytes(hashlib.sha256(w.lower().encode()).digest()[:8], "big")
                v[h % dims] += 1 if h >> 32 & 1 else -1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return pd.Series(out)

    return run(text)


@dataclass
class Client:
    """Documents in, answers out. ``embed`` is any function of a text column; the default only hashes tokens."""

    spark: SparkSession
    embed: Callable[[Column], Column] = hashed_embedding
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    blocked: list[str] = field(default_factory=lambda: ["ignore previous instructions", "system prompt"])
    leakage: list[str] = field(default_factory=lambda: ["password", "api key"])
    chunks: DataFrame | None = None

    def process(self, docs: DataFrame, f=chunking.chunk_any, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, chunk_index, chunk_id, text, chunk_hash, metadata): normalised, chunked, enriched and masked."""
        clean = docs.select(F.col(id_col).alias("doc_id"), guardrails.normalised(F.col(text_col)).alias("text"))
        c = chunking.chunk_documents(clean, f, "doc_id", "text")
        c = c.withColumn("text", guardrails.mask(F.col("chunk"))).drop("chunk")
        return c.withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index")).withColumn("metadata", enrich.metadata(F.col("text")))

    def index(self, chunks: DataFrame, path: str | None = None) -> DataFrame:
        """Chunks with their vectors, scaled to length one; written to ``path`` if given. Chunks of a known id replace the old ones."""
        new = chunks.withColumn("embedding", self.embed(F.col("text"))).withColumn("embedding", vectors.l2_normalise(F.col("embedding")))
        if self.chunks is not None:
            old = self.chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
            new = old.unionByName(new)
        if path:
            new.write.mode("overwrite").parquet(path)
            new = self.spark.read.parquet(path)
        self.chunks = new
        return new

    def save(self, path: str) -> None:
        """The index as Parquet tables under ``path``: chunks, postings, frequencies, nodes and edges."""
        if self.chunks is None:
            raise ValueError("nothing is indexed")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        chunks = self.spark.read.parquet(f"{path}/chunks")
        postings = lexical.postings(chunks, "chunk_id")
        postings.write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.spark.read.parquet(f"{path}/postings")
        stored.groupBy("token").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/frequencies")
        edges = self._edges(chunks)
        edges.write.mode("overwrite").parquet(f"{path}/edges")
        graph.nodes(self.spark.read.parquet(f"{path}/edges")).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **settings: object) -> Client:
        """A client over a saved index; searches read its tables."""
        client = cls(spark, **settings)
        client.chunks = spark.read.parquet(f"{path}/chunks")
        return client

    @staticmethod
    def _edges(chunks: DataFrame) -> DataFrame:
        flat = chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("metadata.entities").alias("entities"), F.col("metadata.tags").alias("tags"))
        return graph.edges(flat, "chunk_id", "doc_id", ["entities"], ["tags"])

    def search(self, query: str, k: int = 5) -> DataFrame:
        """The k best chunks by fused vector, keyword and graph scores, from three times as many candidates each."""
        if self.chunks is None:
            raise ValueError("nothing is indexed")
        c = self.chunks
        q = self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()["v"]
        semantic = vectors.nearest(c, q, 3 * k, "chunk_id").withColumnRenamed("score", "semantic_score")
        words = lexical.keyword_search(c, query, 3 * k, "chunk_id").select("chunk_id", F.col("score").alias("lexical_score"))
        edges = self._edges(c.join(semantic.select("chunk_id").union(words.select("chunk_id")).distinct(), "chunk_id", "left_semi"))
        scores = graph.score(edges, lexical.query_terms(query)).select(F.expr("substring(src, 10)").alias("chunk_id"), "graph_score")
        best = ranking.fuse(semantic, words, scores, self.weights, k, "chunk_id")
        return best.join(c.select("chunk_id", "doc_id", "text"), "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def contexts(self, question: str, k: int = 3, least_semantic: float = 0.0, least_score: float = 0.05, least_overlap: float = 0.05) -> DataFrame:
        """The hits that are near enough; where there are none, the chunks whose words overlap the question's enough."""
        hits = self.search(question, k).filter((F.col("score") >= least_score) & (F.col("semantic_score") >= least_semantic))
        if not hits.isEmpty():
            return hits.select("chunk_id", "doc_id", "text", "score")
        asked = guardrails.token_set(F.lit(question))
        found = self.chunks.select("chunk_id", "doc_id", "text", F.round(ranking.blended(asked, guardrails.token_set(F.col("text"))), 6).alias("score"))
        return found.filter(F.col("score") >= least_overlap).orderBy(F.desc("score"), "chunk_id").limit(k)

    def ask(self, question: str, k: int = 3) -> dict:
        """decision, answer, confidence and citations of one question, under the guardrails."""
        q = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        hits = self.contexts(question, k)
        contexts = hits.groupBy().agg(F.collect_list("text").alias("contexts")).select(F.lit(0).alias("query_id"), "contexts")  # k rows
        r = guardrails.evaluate(q, contexts, self.blocked, self.leakage, [], []).first()
        cited = [] if r["answer"] is None else [h["chunk_id"] for h in hits.select("chunk_id").collect()]
        return {"decision": r["decision"], "answer": r["answer"], "confidence": r["confidence"], "findings": list(r["findings"]), "citations": cited}

    def history(self, messages: DataFrame, n: int = 8) -> DataFrame:
        return access.session_history(messages, n=n)
