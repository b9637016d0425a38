"""Queries of the smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import access, cases, enrich, guardrails, records
from orbweaver.session import load
from orbweaver.sources.formats import video


def path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of the events' JSON by its path."""
    return load(spark, sf_dir, "events").select("event_id", records.path(F.col("props"), "k").cast("long").alias("k"))


def text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", records.joined_text(["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("body"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from numbers: milliseconds where they are over ten thousand million, else seconds."""
    o = load(spark, sf_dir, "orders")
    n = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 1000 + 1_700_000_000_000).otherwise(F.col("o_orderkey") + 1_700_000_000)
    return o.select("o_orderkey", F.date_format(records.event_time(n, "number"), "yyyy-MM-dd HH:mm:ss").alias("at"))


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", enrich.record_text(["c_name", "c_mktsegment", "c_nationkey"], "shop.customer", "c_custkey").alias("body"))


def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter("value IS NOT NULL")
    s = F.col("event_id") % 5000 + 0.75
    return e.select("event_id", enrich.clock(s).alias("truncated"), enrich.clock(s, True).alias("rounded"))


def metric_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Vibration_", "oilTemp.", "current-", "flow ", "x"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_partkey"))
    return p.select("p_partkey", access.metric_kind(name).alias("kind"))


def ticket_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("1", "2", "3", "6", "7", "WAPPR", "odd"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", access.ticket_state(code).alias("state"))


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid over by new balances of every second one."""
    c = load(spark, sf_dir, "customer")
    new = c.filter("c_custkey % 2 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, 1.5).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return cases.upsert(c, new, "c_custkey", ["c_mktsegment", "c_acctbal"])


def due_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("next_eval_at"))
    return cases.due(o, F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


def policy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = guardrails.policy_findings(F.col("text"), [{"name": "a", "terms": ["the and"], "action": "warn"}, {"name": "b", "terms": ["of th", "zzzz"]}])
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["policy"], x["term"], x["severity"])), ",").alias("hits"))


def off_topic_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", guardrails.off_topic(F.col("text"), ["the", "er", "thing"], 0.15).alias("off_topic"))


def registration_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "h").alias("header"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("t").alias("template"))
    return access.registration_gaps(c, ["header", "template"]).select("c_custkey", F.array_join("missing", ",").alias("missing"))


def scene_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spoken segments over three scenes each: the interval-overlap join."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("video"), (F.col("l_linenumber") * 40 - 40).cast("double").alias("start"), (F.col("l_linenumber") * 40 - 40 + F.col("l_quantity")).alias("end"), F.col("l_linenumber").cast("string").alias("text"))
    s = li.select("video").distinct().select("video", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("scene"))
    s = s.select("video", "scene", (F.col("scene") * 100.0).alias("start"), (F.col("scene") * 100.0 + 100).alias("end"))
    return video.transcript_by_scene(s, li).select("video", "scene", "transcript")


def contact_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.element_at(F.array(F.lit("sms"), F.lit("email")), (F.col("event_id") % 2 + 1).cast("int")).alias("channel"), F.col("ts").cast("timestamp").alias("now"), (F.col("event_id") % 5 == 0).alias("dnd"))
    got = cases.contact_check(e, cases.ContactPolicy(hours={"*": (8, 19)}, require_consent=()), dnd="dnd")
    return got.select("event_id", "allowed", F.array_join("reasons", "; ").alias("reasons"))


def pii_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guardrails.detections(F.col("text"), ["email", "ssn", "ip_address", "jwt"])
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("found"))


QUERIES = {
    f.__name__: f
    for f in (
        path_projection, text_projection, event_times, record_texts, clock_labels, metric_kinds, ticket_states, upsert_changes, due_orders, policy_hits, off_topic_turns,
        registration_gaps, scene_transcripts, contact_hours, pii_detectors,
    )
}


def _has(d: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{guardrails.PATTERNS[d]}') THEN '{d}' END"


ORACLES = {
    "path_projection": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "text_projection": "SELECT o_orderkey, concat_ws(' ', o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, o_orderpriority) AS body FROM orders",
    "event_times": "SELECT o_orderkey, strftime(make_timestamp((CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 1000 + 1700000000000 ELSE (o_orderkey + 1700000000) * 1000 END) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM orders",
    "record_texts": "SELECT c_custkey, '[Table: shop.customer | Record: ' || c_custkey || '] ' || concat_ws(' | ', 'c_name: ' || c_name, CASE WHEN c_custkey % 3 <> 0 THEN 'c_mktsegment: ' || c_mktsegment END, 'c_nationkey: ' || c_nationkey) AS body FROM customer",
    "clock_labels": """WITH s AS (SELECT event_id, (event_id % 5000)::BIGINT AS a, (event_id % 5000 + 1)::BIGINT AS b FROM events WHERE value IS NOT NULL)
SELECT event_id, lpad((a // 60)::VARCHAR, 2, '0') || ':' || lpad((a % 60)::VARCHAR, 2, '0') AS truncated, lpad((b // 60)::VARCHAR, 2, '0') || ':' || lpad((b % 60)::VARCHAR, 2, '0') AS rounded FROM s""",
    "metric_kinds": "SELECT p_partkey, ['vibration', 'temperature', 'current', 'flow', 'other'][p_partkey % 5 + 1] AS kind FROM part",
    "ticket_states": "SELECT o_orderkey, ['open', 'in_progress', 'on_hold', 'resolved', 'closed', 'open', 'in_progress'][o_orderkey % 7 + 1] AS state FROM orders",
    "upsert_changes": """WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1000000 ELSE 0 END AS k, c_mktsegment AS m, CASE WHEN c_custkey % 4 = 0 THEN 1.5 ELSE c_acctbal END AS b FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(k, c_custkey) AS c_custkey, CASE WHEN k IS NOT NULL THEN m ELSE c_mktsegment END AS c_mktsegment, CASE WHEN k IS NOT NULL THEN b ELSE c_acctbal END AS c_acctbal,
 k IS NOT NULL AND (c_custkey IS NULL OR m IS DISTINCT FROM c_mktsegment OR b IS DISTINCT FROM c_acctbal) AS changed FROM customer FULL OUTER JOIN n ON k = c_custkey""",
    "due_orders": "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderdate <= TIMESTAMP '1996-01-01'",
    "policy_hits": """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the and') THEN 'a:the and:warn' END, CASE WHEN contains(lower(text), 'of th') THEN 'b:of th:block' END, CASE WHEN contains(lower(text), 'zzzz') THEN 'b:zzzz:block' END], lambda x: x IS NOT NULL), ',') AS hits FROM conversations""",
    "off_topic_turns": """WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))) AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, ['the', 'er', 'thing'])) / sqrt(len(a)::DOUBLE * 3) END < 0.15 AS off_topic FROM t""",
    "registration_gaps": "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 THEN 'header' END, CASE WHEN c_custkey % 3 = 0 THEN 'template' END) AS missing FROM customer",
    "scene_transcripts": """WITH l AS (SELECT l_orderkey::VARCHAR AS video, l_linenumber * 40 - 40 AS s, l_linenumber * 40 - 40 + l_quantity AS e, l_linenumber::VARCHAR AS t FROM lineitem),
c AS (SELECT DISTINCT video, unnest([0, 1, 2]) AS scene FROM l)
SELECT c.video, scene, coalesce(string_agg(t, ' ' ORDER BY s, t) FILTER (t IS NOT NULL), '') AS transcript FROM c LEFT JOIN l ON l.video = c.video AND s < scene * 100 + 100 AND e > scene * 100 GROUP BY 1, 2""",
    "contact_hours": """WITH r AS (SELECT event_id, hour(ts) < 8 OR hour(ts) >= 19 AS h, event_id % 5 = 0 AND event_id % 2 = 0 AS d FROM events)
SELECT event_id, NOT h AND NOT d AS allowed, concat_ws('; ', CASE WHEN h THEN 'outside contact hours 08:00-19:00' END, CASE WHEN d THEN 'recipient is on do-not-disturb for sms' END) AS reasons FROM r""",
    "pii_detectors": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(map(_has, ("email", "ssn", "ip_address", "jwt"))) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents",
}
