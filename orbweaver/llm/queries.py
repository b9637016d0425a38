"""The queries of the llm operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.llm import bpe, decontaminate, html, langid, quality, records, repeats, simhash, topk, units
from orbweaver.session import cut, drop_path, load, scratch_path


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 3 differing bits or fewer)."""
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that also start elsewhere."""
    return repeats.repeats_report(load(spark, sf_dir, "documents"), length=400)


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; driver and executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of every document by the rank file, and the bytes they decode to, as digests."""
    import public_tokenizers

    return bpe.round_trip(load(spark, sf_dir, "documents"), path or tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_records(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids of every document, written to record files in ascending doc_id order and read back from them."""
    place = scratch_path(spark, "records")
    manifest = records.write_records(load(spark, sf_dir, "documents"), place, path or tokenizer_file("byte_bpe_50k.json"), end_id=2, special_as_text=False)
    found = cut(records.read_records(spark, place, manifest))
    drop_path(spark, place)
    return found


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    return langid.identify(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines (5 words or more) that occur earlier; their places are kept."""
    return _line_dedup(spark, sf_dir, 5)


def op6_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that occur earlier, however short; their places are kept."""
    return _line_dedup(spark, sf_dir, 1)


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without sentences (16 words or more) that occur earlier; their places are kept."""
    return _line_dedup(spark, sf_dir, 16, "sentence")


def _line_dedup(spark: SparkSession, sf_dir: str, min_words: int, by: str = "line") -> DataFrame:
    found = units.dedup_units(load(spark, sf_dir, "documents"), by=by, min_words=min_words)
    places = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["size"])), ",")
    return found.select("doc_id", "n_units", "n_removed", places.alias("removed"), "kept_text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document by two co-trained views."""
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all others."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(v.filter("vec_id % 50 = 0"), v, k=5)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 8 words in every document."""
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), size=8, min_items=2)


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_records": op4_token_records,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op6_line_dedup_all": op6_line_dedup_all,
    "op6_sentence_dedup": op6_sentence_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_topk": op8_exact_topk,
    "op9_html_extraction": op9_html_extraction,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
n AS (SELECT doc_id, i, len(ls[i]) AS size, list_sum(list_transform(ls[1:i - 1], lambda x: len(x) + 1)) AS before,
  trim(regexp_replace(lower(ls[i]), '[\x09-\x0D\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS norm FROM u),
k AS (SELECT *, len(string_split(norm, ' ')) >= 5 AS counts FROM n),
r AS (SELECT *, CASE WHEN counts THEN row_number() OVER (PARTITION BY norm, counts ORDER BY doc_id, i) > 1 ELSE false END AS gone FROM k),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(coalesce(before, 0)::BIGINT || ':' || size, ',' ORDER BY i) FILTER (gone) AS removed, list(i ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  coalesce(array_to_string(list_transform(kept, lambda i: ls[i]), chr(10)), '') AS kept_text FROM d LEFT JOIN g USING (doc_id)""",
    "op6_sentence_dedup": r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]+[.!?]*|[.!?\n]') AS ls FROM documents),
u AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
n AS (SELECT doc_id, i, len(ls[i]) AS size, list_sum(list_transform(ls[1:i - 1], lambda x: len(x))) AS before,
  trim(regexp_replace(lower(ls[i]), '[\x09-\x0D\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS norm FROM u),
k AS (SELECT *, len(string_split(norm, ' ')) >= 16 AS counts FROM n),
r AS (SELECT *, CASE WHEN counts THEN row_number() OVER (PARTITION BY norm, counts ORDER BY doc_id, i) > 1 ELSE false END AS gone FROM k),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(coalesce(before, 0)::BIGINT || ':' || size, ',' ORDER BY i) FILTER (gone) AS removed, list(i ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  coalesce(array_to_string(list_transform(kept, lambda i: ls[i]), ''), '') AS kept_text FROM d LEFT JOIN g USING (doc_id)""",
    "op8_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2]))::BIGINT AS score FROM q JOIN v ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, ws[i:i + 7] AS w FROM bi),
lens AS (SELECT DISTINCT len(w) AS l FROM win),
di AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, lens WHERE len(ws) >= l),
hits AS (SELECT doc_id, item_id, i, l FROM (SELECT doc_id, i, l, ws[i:i + l - 1] AS w FROM di) JOIN win USING (w)),
pos AS (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
