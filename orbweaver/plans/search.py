"""Retrieval queries: postings, keyword search, nearest neighbours, fusion, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import graph, guardrails, lexical, ranking, vectors
from orbweaver.session import load

QUERY = "secure data thing with er then ingre"
_TERMS = lexical.query_terms(QUERY)
_LIST = ", ".join(f"'{t}'" for t in _TERMS)


def lexical_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.keyword_search(load(spark, sf_dir, "documents"), QUERY, k=10)


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every token."""
    post = lexical.postings(load(spark, sf_dir, "documents"))
    return post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_to(load(spark, sf_dir, "embeddings"), 7, k=10)


def l2_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalise(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(vectors.norm(F.col("u")), 6).alias("length"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(load(spark, sf_dir, "documents"), parent="source", tags=["lang"])


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def graph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.score(_edges(spark, sf_dir), ["src1", "fr"])


def graph_adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))


def hybrid_fusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword candidates (3 times the limit each) fused with graph scores."""
    k = 10
    semantic = vectors.nearest_to(load(spark, sf_dir, "embeddings"), 7, k=3 * k).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("semantic_score"))
    words = lexical.keyword_search(load(spark, sf_dir, "documents"), QUERY, k=3 * k).select("doc_id", F.col("score").alias("lexical_score"))
    wanted = semantic.select("doc_id").union(words.select("doc_id")).distinct()  # 6 k rows at most
    near = load(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(F.broadcast(wanted), "doc_id", "left_semi")
    scores = graph.score(graph.edges(near, parent="source", tags=["lang"]), ["src1", "fr"]).select(F.substring_index("src", ":", -1).cast("long").alias("doc_id"), "graph_score")
    return ranking.fuse(semantic, words, scores, (0.5, 0.3, 0.2), k)


def token_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blended overlap of one question with every benchmark item, best ten."""
    q = F.array(*[F.lit(t) for t in _TERMS])
    b = load(spark, sf_dir, "benchmark").withColumn("t", guardrails.token_set(F.col("text")))
    return b.select("item_id", F.round(ranking.blended(q, F.col("t")), 6).alias("score")).orderBy(F.desc("score"), "item_id").limit(10)


QUERIES = {f.__name__: f for f in (lexical_search_topk, postings_stats, knn_cosine_topk, l2_norms, graph_edges, graph_score, graph_adjacency_degree, hybrid_fusion_topk, token_overlap_score)}

_EDGES = """(SELECT 'document:' || doc_id AS src, 'PART_OF' AS rel, 'parent:' || source AS dst FROM documents WHERE source IS NOT NULL
 UNION ALL SELECT 'document:' || doc_id, 'TAGGED_AS', 'tag:' || lang FROM documents WHERE lang IS NOT NULL)"""
_GRAPH = f"""(SELECT src, avg(CASE WHEN contains('parent ' || lower(substr(dst, 8)), 'src1') AND rel = 'PART_OF' OR contains('parent ' || lower(substr(dst, 8)), 'fr') AND rel = 'PART_OF'
  OR rel = 'TAGGED_AS' AND (contains('tag ' || lower(substr(dst, 5)), 'src1') OR contains('tag ' || lower(substr(dst, 5)), 'fr')) THEN 1.0 ELSE 0.0 END) AS graph_score
 FROM (SELECT DISTINCT src, rel, dst FROM {_EDGES}) GROUP BY src)"""
_KNN = """(SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.v, q.v))), 6) AS score
 FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) q)"""
_LEX = f"""(WITH toks AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_\\-]+'))) AS token FROM documents),
post AS (SELECT token, doc_id, count(*) AS tf FROM toks WHERE token IN ({_LIST}) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents),
terms AS (SELECT unnest([{_LIST}]) AS token),
df AS (SELECT t.token, count(p.doc_id) AS df FROM terms t LEFT JOIN post p USING (token) GROUP BY 1),
idf AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n),
tot AS (SELECT sum(idf) AS total FROM idf)
SELECT doc_id, round(sum(idf) / max(total), 6) AS score, sum(tf)::BIGINT AS tf_sum, count(*)::BIGINT AS matched
FROM post JOIN idf USING (token), tot GROUP BY doc_id)"""

ORACLES = {
    "lexical_search_topk": f"SELECT * FROM {_LEX} ORDER BY score DESC, tf_sum DESC, doc_id LIMIT 10",
    "postings_stats": """WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_\\-]+'))) AS token FROM documents),
p AS (SELECT token, doc_id, count(*) AS tf FROM t GROUP BY 1, 2) SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM p GROUP BY 1""",
    "knn_cosine_topk": f"SELECT * FROM {_KNN} ORDER BY score DESC, vec_id LIMIT 10",
    "l2_norms": """SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0 AS length FROM embeddings""",
    "graph_edges": f"SELECT * FROM {_EDGES}",
    "graph_score": f"SELECT * FROM {_GRAPH}",
    "graph_adjacency_degree": f"SELECT node, count(DISTINCT other) AS degree FROM (SELECT src AS node, dst AS other FROM {_EDGES} UNION ALL SELECT dst, src FROM {_EDGES}) GROUP BY 1",
    "hybrid_fusion_topk": f"""WITH s AS (SELECT vec_id AS doc_id, score AS semantic_score FROM {_KNN} ORDER BY score DESC, vec_id LIMIT 30),
l AS (SELECT doc_id, score AS lexical_score FROM {_LEX} ORDER BY score DESC, tf_sum DESC, doc_id LIMIT 30),
g AS (SELECT split_part(src, ':', 2)::BIGINT AS doc_id, graph_score FROM {_GRAPH})
SELECT doc_id, coalesce(semantic_score, 0) AS semantic_score, coalesce(lexical_score, 0) AS lexical_score, coalesce(graph_score, 0) AS graph_score,
 round((0.5 * coalesce(semantic_score, 0) + 0.3 * coalesce(lexical_score, 0) + 0.2 * coalesce(graph_score, 0)) / 1.0, 6) AS score
FROM s FULL OUTER JOIN l USING (doc_id) LEFT JOIN g USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""",
    "token_overlap_score": f"""WITH b AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS t FROM benchmark), q AS (SELECT [{_LIST}] AS q)
SELECT item_id, round(CASE WHEN len(t) = 0 THEN 0 ELSE 0.65 * len(list_intersect(q, t)) / sqrt(len(q)::DOUBLE * len(t)) + 0.35 * (len(list_intersect(q, t))::DOUBLE / len(q)) END, 6) AS score FROM b, q ORDER BY score DESC, item_id LIMIT 10""",
}
