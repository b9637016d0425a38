"""Queries of enrichment, chunking, transforms, masking and chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import access, chunking, enrich, guardrails, records
from orbweaver.session import load


def chunk_words_80_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_words(load(spark, sf_dir, "documents"), 80, 12)


def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct e-mails, dates and money, tags and class of every document."""
    t = enrich.tags(F.col("text"))
    cols = {n: F.array_join(enrich.all_matches(F.col("text"), p), "|") for n, p in (("emails", enrich.EMAIL), ("dates", enrich.DATE), ("money", enrich.MONEY))}
    return load(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()], F.array_join(t, "|").alias("tags"), enrich.classify(t).alias("classification"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of texts in plain ASCII (regex engines differ on word ends elsewhere)."""
    d = load(spark, sf_dir, "documents").filter(~F.rlike("text", F.lit(r"[^\x00-\x7F]")))
    return d.select("doc_id", F.size(enrich.all_matches(F.col("text"), enrich.ENTITY)).alias("n_entities"))


def entity_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every text; word ends and white space are those of Unicode, which DuckDB's engine hasn't."""
    found = enrich.all_matches(F.col("text"), "(?U)" + enrich.ENTITY)
    return load(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_entities"))


def transform_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return records.transform(c, rename={"c_name": "name", "c_mktsegment": "segment"}, defaults={"tier": "basic"}, case={"name": "lower", "segment": "title"}, redact_pii=True)


def validate_and_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user that has all required fields."""
    e = load(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    valid, _ = records.validate(e, ["user_id", "event_type", "value"], "user_id", "event_id")
    return valid.select("event_id", "user_id", "event_type", "value")


def invalid_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    e = e.withColumn("value", F.when(e.event_id % 7 == 0, None).otherwise(e.value)).withColumn("event_type", F.when(e.event_id % 14 == 0, None).otherwise(e.event_type))
    _, bad = records.validate(e, ["user_id", "event_type", "value"], "user_id", "event_id")
    return bad.groupBy("error").agg(F.count("*").alias("n"))


def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.high_water_mark(load(spark, sf_dir, "events"), "ts")


def row_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", enrich.narrative(["o_custkey", "o_orderstatus", "o_orderpriority"], "orders", ["o_orderkey"]).alias("narrative"))


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of 20 orders a chunk."""
    o = load(spark, sf_dir, "orders").withColumn("seq", F.col("o_orderkey"))
    return chunking.row_groups(o, enrich.narrative(["o_custkey", "o_orderstatus"], "orders", ["o_orderkey"]), "seq", 20)


def chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chat_threads(load(spark, sf_dir, "conversations"))


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.session_history(load(spark, sf_dir, "conversations"), n=3)


def pii_detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ["api_key", "credit_card", "email", "ip_address", "jwt", "ssn"]
    return load(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in guardrails.detection_counts(F.col("text"), d).items()])


def mask_pii_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", guardrails.mask(F.col("text")).alias("masked"))


def dedupe_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    d = load(spark, sf_dir, "documents").select("doc_id", enrich.content_hash(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def mask_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    address = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).otherwise(F.concat(F.lit("+1555"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    return c.select("c_custkey", enrich.mask_recipient(address).alias("masked"))


def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", enrich.idempotency_key([F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.col("o_orderstatus")], most=25).alias("key"))


def render_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", enrich.render("Dear {name}, your {{plan}} is {segment}{missing}.", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("message"))


def prompt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(guardrails.inspect_prompt(F.col("text"), ["ignore", "the the"], ["password", "er"]), "|").alias("findings"))


def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each turn is grounded in the turn before it."""
    from pyspark.sql import Window

    c = load(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    g = guardrails.grounding(F.col("text"), F.when(F.col("before").isNotNull(), F.array("before")), 0.3)
    return c.select("conv_id", "turn", g["confidence"].alias("confidence"), g["blocked"].alias("blocked"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_words_80_12, metadata_extract, entity_counts, entity_counts_all, transform_records, validate_and_dedupe, invalid_reasons, high_water_mark, row_narratives, table_chunks,
        chat_threads, session_history, pii_detect_counts, mask_pii_docs, dedupe_content_hash, mask_recipients, idempotency_keys, render_messages, prompt_findings, grounding_check,
    )
}


def _re(name: str) -> str:
    return guardrails.PATTERNS[name].replace("'", "''")


def _found(p: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{p}'))), '|')"


def _tag_sql() -> str:
    out = []
    for tag in sorted(enrich.DEFAULT_TAGS):
        hit = " OR ".join(f"contains(lower(text), '{w}')" for w in enrich.DEFAULT_TAGS[tag])
        out.append(f"CASE WHEN {hit} THEN '{tag}' END")
    return "list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL)"


ORACLES = {
    "chunk_words_80_12": """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 80 THEN 1 ELSE ceil((len(ws) - 80) / 68.0)::INT + 1 END AS n FROM d),
i AS (SELECT doc_id, ws, unnest(range(n)) AS i FROM c)
SELECT doc_id, i::INT AS chunk_index, array_to_string(ws[i * 68 + 1:i * 68 + 80], ' ') AS chunk FROM i""",
    "metadata_extract": f"""WITH t AS (SELECT doc_id, text, {_tag_sql()} AS tags FROM documents)
SELECT doc_id, {_found(enrich.EMAIL)} AS emails, {_found(enrich.DATE)} AS dates, {_found(enrich.MONEY)} AS money, array_to_string(tags, '|') AS tags,
 CASE WHEN list_contains(tags, 'security') THEN 'security' WHEN list_contains(tags, 'finance') THEN 'finance' WHEN list_contains(tags, 'customer') THEN 'customer' ELSE 'general' END AS classification FROM t""",
    "entity_counts": f"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{enrich.ENTITY}')))::INT AS n_entities FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')""",
    "transform_records": f"""SELECT c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '{enrich.EMAIL}', '[REDACTED_EMAIL]', 'g'), '{records.PHONE}', '[REDACTED_PHONE]', 'g') AS name,
 upper(left(trim(c_mktsegment), 1)) || lower(substr(trim(c_mktsegment), 2)) AS segment, 'basic' AS tier FROM customer""",
    "validate_and_dedupe": """WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
v AS (SELECT * FROM e WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL)
SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM v) WHERE r = 1""",
    "invalid_reasons": """WITH e AS (SELECT user_id, CASE WHEN event_id % 14 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
r AS (SELECT list_filter([CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN event_type IS NULL THEN 'event_type' END, CASE WHEN value IS NULL THEN 'value' END], lambda x: x IS NOT NULL) AS m FROM e)
SELECT 'missing required fields: ' || array_to_string(m, ', ') AS error, count(*) AS n FROM r WHERE len(m) > 0 GROUP BY 1""",
    "high_water_mark": "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS high_water_mark FROM events",
    "row_narratives": "SELECT o_orderkey, '[Table: orders | PK: ' || o_orderkey || '] o_custkey: ' || coalesce(o_custkey::VARCHAR, 'NULL') || ' | o_orderstatus: ' || coalesce(o_orderstatus, 'NULL') || ' | o_orderpriority: ' || coalesce(o_orderpriority, 'NULL') AS narrative FROM orders",
    "table_chunks": """SELECT floor(o_orderkey / 20)::BIGINT AS chunk_index, string_agg('[Table: orders | PK: ' || o_orderkey || '] o_custkey: ' || o_custkey || ' | o_orderstatus: ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS chunk FROM orders GROUP BY 1""",
    "chat_threads": "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1",
    "session_history": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3",
    "pii_detect_counts": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_re(d)}'))::BIGINT AS n_{d}" for d in ("api_key", "credit_card", "email", "ip_address", "jwt", "ssn")) + " FROM documents",
    "dedupe_content_hash": "SELECT md5(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "mask_recipients": """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@example.com' ELSE '+1555' || lpad(c_custkey::VARCHAR, 7, '0') END AS a FROM customer)
SELECT c_custkey, CASE WHEN contains(a, '@') THEN left(a, 1) || '***@' || split_part(a, '@', 2) ELSE left(a, 2) || repeat('*', length(a) - 4) || right(a, 2) END AS masked FROM a""",
    "idempotency_keys": """WITH k AS (SELECT o_orderkey, 'order-' || o_orderkey || '|' || trim(regexp_replace(trim(o_orderpriority), '[^A-Za-z0-9._:-]+', '-', 'g'), '-') || '|' || o_orderstatus AS k FROM orders)
SELECT o_orderkey, CASE WHEN length(k) <= 25 THEN k ELSE '' || '#' || left(sha256(k), 24) END AS key FROM k""",
    "render_messages": "SELECT c_custkey, 'Dear ' || c_name || ', your {plan} is ' || c_mktsegment || '.' AS message FROM customer",
    "prompt_findings": """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(lower(text), 'ignore') THEN 'blocked pattern: ignore' END, CASE WHEN contains(lower(text), 'the the') THEN 'blocked pattern: the the' END,
 CASE WHEN contains(lower(text), 'password') THEN 'leakage term: password' END, CASE WHEN contains(lower(text), 'er') THEN 'leakage term: er' END], lambda x: x IS NOT NULL), '|') AS findings FROM conversations""",
    "grounding_check": """WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
t AS (SELECT conv_id, turn, b, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS a, list_distinct(list_transform(regexp_extract_all(coalesce(b, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))) AS k FROM c),
g AS (SELECT conv_id, turn, b, CASE WHEN b IS NULL OR len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, k))::DOUBLE / len(a) END AS s FROM t)
SELECT conv_id, turn, round(s, 4) AS confidence, b IS NULL OR s < 0.3 AS blocked FROM g""",
}
