"""Queries of feeds, services and jobs, each with its SQL."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver import jobs, providers
from orbweaver.operators import access, cases, cdc, chunking, enrich, guardrails, intents, outbound, service, telemetry
from orbweaver.plans.text import _tag_sql
from orbweaver.session import load, spread
from orbweaver.sources import files, replication
from orbweaver.streaming import kafka


def _text(*parts: object) -> Column:
    """Literals and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _one_of(values: list[str | None], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def document_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents with a nested part, flattened."""
    e = spread(load(spark, sf_dir, "events"), "event_id")
    doc = _text('{"_id": ', F.col("event_id"), ', "kind": "', F.col("event_type"), '", "gone": null, "at": {"user": ', F.col("user_id"), ', "props": ', F.col("props"), '}, "list": [1, 2], "subs": [{"a": 1}, {"b": "x"}]}')
    return chunking.chunk_collection(e.select("event_id", doc.alias("document")), "events").select("event_id", "chunk")


def reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as threads: every fourth names a thread, every fifth replies, the rest go to windows of 2."""
    c = load(spark, sf_dir, "conversations")
    c = c.withColumn("thread", F.when(F.col("turn") % 4 == 3, "t1")).withColumn("reply_to", F.when(F.col("turn") % 5 == 2, "m2")).withColumn("at", F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")))
    return chunking.reply_threads(c, "chat", "turn", "thread", "reply_to", "role", "text", "at", turns=2, conversation="conv_id")


def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("uuid"), F.col("c_mktsegment").alias("segment"))
    return c.select("c_custkey", cdc.record_key(["segment", "id", "uuid"]).alias("key"), cdc.record_key(["segment"], explicit=["c_custkey", "segment"]).alias("explicit"))


def chat_event_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = load(spark, sf_dir, "events"), F.col("event_id")
    body = [
        _text('{"type": "message", "text": "hello", "ts": "', k, '"}'),
        _text('{"type": "message", "subtype": "message_deleted", "previous_message": {"ts": "', k, '"}}'),
        _text('{"type": "message", "subtype": "message_changed", "message": {"ts":"', k, '","text":"new"}}'),
        F.lit('{"type": "message", "subtype": "channel_join", "text": "joined"}'),
        F.lit('{"type": "reaction_added"}'),
        F.lit('{"type": "message", "text": ""}'),
    ]
    event = F.element_at(F.array(*body), (k % 6 + 1).cast("int"))
    return cdc.chat_events(e.select("event_id", event.alias("event"))).select("event_id", "action", "message", "deleted_ts")


def redacted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    text = _text("mail ", F.lower("c_name"), "@shop.example, call +91 9876543210 or (044) 555-0", F.col("c_custkey"), "12, pan abcde1234f, id 1234 5678 9012, ref INV", F.col("c_custkey") + 1000000, "X")
    return c.select("c_custkey", intents.redact(text).alias("text"))


def output_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that show an address or a number, with and without citations and masking."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    answer = F.when(k % 3 == 0, _text("write to a", k, "@x.org")).when(k % 3 == 1, "ring 415-555-0123").otherwise("no data")
    found = guardrails.output_findings(answer, k % 4, k % 5 == 0, [{"name": "cite", "require_citations": True, "action": "warn"}, {"name": "mask", "require_masking": True}])
    return c.select("c_custkey", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["policy"], x["needs"], x["severity"])), ",").alias("findings"), guardrails.raw_pii(answer).alias("raw"))


def _card(k: Column) -> Column:
    return F.lpad((k * 7919 + 4000000000000000).cast("string"), 16, "0")


def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", enrich.luhn(_card(k)).alias("card"), enrich.luhn((k * 13).cast("string")).alias("short"), guardrails.raw_pii(_text("paid by ", _card(k))).alias("shown"))


def truncated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of three tables; every 97th truncates its own."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    ch = o.select(k.alias("at"), F.col("o_orderstatus").alias("table"), F.col("o_custkey").alias("key"), F.when(k % 97 == 0, "TRUNCATE").when(k % 11 == 0, "DELETE").otherwise("UPDATE").alias("operation"))
    left = cdc.after_truncates(ch, "at", "table").withColumn("id", F.struct("table", "key"))
    return cdc.latest_state(left, "id", ["at"]).select(F.col("id.table").alias("table"), F.col("id.key").alias("key"), "at")


def table_chunks_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives of 20 orders of status O a chunk, whose keys have gaps."""
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return chunking.row_groups(chunking.ranked(o, "o_orderkey"), enrich.narrative(["o_custkey"], "orders", ["o_orderkey"]), "seq", 20)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return load(spark, sf_dir, "events").select("event_id", _one_of(["db.latency_ms", "api.error_rate", "queue.depth"], k).alias("name"), F.when(k % 3 == 1, k % 100 / 1000).otherwise((k % 4000).cast("double")).alias("value"))


def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the whole history, of which those of even events are known."""
    m = _metrics(spark, sf_dir)
    ai = load(spark, sf_dir, "events").select((F.col("event_id") + 1_000_000_000).alias("event_id"), (F.col("event_id") % 10 / 10).alias("confidence"))
    known = telemetry.alerts_of(m.filter("event_id % 2 = 0"))
    return telemetry.new_alerts(m, ai, known)


def trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.lit("web").alias("service"), F.col("event_type").alias("operation"), (F.col("event_id") % 50).alias("duration_ms"), F.col("event_id").cast("string").alias("trace_id"))
    return telemetry.traced(e, F.concat(F.lit("m"), "trace_id"))[1]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.lit("web").alias("service"), _one_of(["INFO", "Warning", "error"], F.col("event_id")).alias("severity"), _text("event ", F.col("event_id")).alias("message"))
    return telemetry.log_rows(e)


def access_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of requests, denied ones included, and how many telemetry rows they come with."""
    roles = spark.createDataFrame([("reader", ["read"], ["*"]), ("admin", ["*"], ["*"])], "role string, permissions array<string>, scopes array<string>")
    tenants = spark.createDataFrame([("t0", ["*"]), ("t1", ["a"])], "tenant string, scopes array<string>")
    k = F.col("n_nationkey")
    r = load(spark, sf_dir, "nation").select(_one_of(["reader", "admin", "none"], k).alias("role"), _one_of(["t0", "t1", "t9"], F.col("n_regionkey")).alias("tenant"), F.lit(None).cast("string").alias("resource_tenant"), _one_of(["read", "write"], k).alias("permission"), F.lit(None).cast("string").alias("scope"), F.when(k % 4 != 0, F.col("n_name")).alias("subject"))
    _, audit, metrics = telemetry.checked_access(r, roles, tenants)
    kept = access.audit(audit, include_denied=True).groupBy("actor", "tenant", "decision", "permission").agg(F.count("*").alias("n"))
    return kept.join(metrics.groupBy(F.col("decision").alias("d"), F.col("permission").alias("p")).agg(F.sum("value").cast("long").alias("n_metrics")), (F.col("d") == F.col("decision")) & (F.col("p") == F.col("permission"))).drop("d", "p")


_CHANNELS = {"web": {"capabilities": ["ask", "session"]}, "sms": {"capabilities": ["session"]}, "fax": {"enabled": False, "capabilities": ["ask"]}}


def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    r = o.select(
        "o_orderkey",
        _one_of(["web", "web", "sms", "fax", "tty", "web", "web"], k).alias("channel"),
        F.col("o_custkey").cast("string").alias("user"),
        _one_of(["t1", "t1", "t1", "t2"], k).alias("tenant"),
        F.when(k % 5 == 0, F.array(F.lit("session"))).otherwise(F.array(F.lit("ask"), F.lit("session"))).alias("permissions"),
        F.repeat(F.lit("q"), (k % 50).cast("int")).alias("query"),
        F.when(k % 2 == 0, (F.col("o_custkey") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string")).alias("session_user"),
        F.lit("t1").alias("session_tenant"),
    )
    return service.admitted(r, _CHANNELS, "ask", "t1", 40).select("o_orderkey", "reason")


def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = load(spark, sf_dir, "events"), F.col("event_id")
    a = _text(_one_of(["10", "127", "172", "192", "169", "100", "8", "224", "999", "0"], k), ".", k % 256, ".", F.when(k % 7 == 0, 2).otherwise(k % 200), ".1")
    return e.select("event_id", outbound.address_kind(a).alias("kind"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    key = F.when(k % 3 == 0, _text('{"payload": {"id": ', k, "}}")).when(k % 3 == 1, _text('{"id": ', k, "}")).otherwise(_text("k", k))
    value = F.when(k % 5 != 0, _text('{"op": "u", "after": {"id": 0, "v": ', k % 9, '}, "source": {"db": "shop", "table": "', F.col("event_type"), '"}, "ts_ms": ', k, "}"))
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("srv.shop."), "event_type").alias("topic"), F.when(k % 4 != 0, key).cast("binary").alias("key"), value.cast("binary").alias("value"))


def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed records and tombstones as changes."""
    return kafka.decode(_records(spark, sf_dir)).select("event_id", "operation", "database", "table", "key", "record")


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    value = F.when(k % 4 == 0, _text("[", k, ",", k + 1, "]")).when(k % 4 == 1, _text("{", '"a": ', k, "}")).when(k % 4 == 2, F.lit(None)).otherwise(_text(k))
    r = load(spark, sf_dir, "events").select("event_id", F.lit("t").alias("topic"), F.lit(None).cast("binary").alias("key"), value.cast("binary").alias("value"))
    return kafka.decode(r, "documents").select("event_id", "document")


def feed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("partition", (F.col("user_id") % 4).cast("int"))
    ends = e.groupBy(F.col("event_type").alias("topic"), "partition").agg(F.min("event_id").alias("low"), (F.max("event_id") + 1).alias("high"))
    done = ends.filter("partition <> 3").select("topic", "partition", F.when(F.col("partition") == 2, -1).when(F.col("partition") == 1, F.col("high") + 5).otherwise(F.col("low") + 3).alias("offset"))
    return kafka.lag(ends, done)


def feed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    held = e.select("topic", "partition").distinct()
    return kafka.next_offsets(e, held.select("topic", "partition", F.when(F.col("partition") == 0, 1_000_000_000).otherwise(1).alias("offset")), held.filter("partition <> 3"))


def slot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = load(spark, sf_dir, "customer").select("c_custkey", (k % 2 == 0).alias("active"), F.concat(F.lit("0/"), F.hex(k * 1000)).alias("confirmed_flush_lsn"), F.when(k % 5 == 0, "lost").otherwise("reserved").alias("wal_status"), F.when(k % 7 == 0, "wal_removed").alias("invalidation_reason"), (k % 11 == 0).alias("conflicting"))
    return replication.slot_states(s, "1/0").select("c_custkey", "lag_bytes", "state")


def records_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = jobs.Job("parts", "p_partkey", ("p_name", "p_type"), transforms={"rename": {"p_brand": "brand"}, "case": {"brand": "lower"}}, tags={"steel": ["steel"], "brass": ["brass"]})
    return jobs.records_job(load(spark, sf_dir, "part"), job).select("record_id", "source_job", F.col("payload.brand").alias("brand"), F.array_join("metadata.tags", "|").alias("tags"))


def documents_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = jobs.Job("docs", "doc_id", text_field="text", title_field="source", chunking=(100, 10), transforms={"trim": False})
    got = jobs.documents_job(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), job)
    return got.select("chunk_id", "document_id", "title", "content_hash", F.length("text").alias("n_chars"), F.col("metadata.classification").alias("classification"))


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    r = _text('{"key": ', F.col("c_custkey"), ', "body": {"title": "', F.col("c_name"), '", "empty": "", "text": "', F.col("c_mktsegment"), '"}', F.when(F.col("c_custkey") % 2 == 0, ', "meta": {"a":1}').otherwise(""), "}")
    return jobs.indexed_documents(c.select(r.alias("record")), jobs.Collection("customers", "key", text_fields=("body.title", "body.empty", "body.text", "body.none"), metadata_field="meta"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), _text("k", F.floor(k / 2)).alias("key"), F.lit("task").alias("kind"), F.lit("repair").alias("action"), (k % 3 == 0).alias("needs_approval"), (k % 5 != 0).alias("sendable"))


def approved_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions queued by the approval of every second case."""
    a = _actions(spark, sf_dir)
    box = a.filter("key LIKE '%7'").select("key").distinct()
    return cases.approved(a, box, load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject")))[1].select("key", "status")


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of orders from what was decided for them, and the tickets of a dry run."""
    k = F.col("o_orderkey")
    a = load(spark, sf_dir, "orders").select(k.cast("string").alias("key"), F.col("o_custkey").cast("string").alias("subject"), F.lit("repair").alias("action"), F.when(k % 2 == 0, F.create_map(F.lit("title"), F.lit("Check pump"), F.lit("work_priority"), (k % 5).cast("string"))).otherwise(F.create_map(F.lit("reason"), F.lit("drift"), F.lit("work_priority"), F.lit("soon"))).alias("outputs"))
    items = cases.work_items(a, F.col("outputs"))
    tickets = cases.submitted(items, items.filter("key LIKE '%3'").select("key", F.concat(F.lit("OLD-"), "key").alias("ref")))
    return items.join(tickets, "key")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    r = load(spark, sf_dir, "events").select("event_id", F.when(k % 3 != 0, k).alias("key"), F.when(k % 2 == 0, F.col("event_type")).alias("value"))
    return cdc.tombstones(r).select("event_id", "operation")


def merged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates of customers laid over what was known."""
    k = F.col("c_custkey")
    old = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    new = F.when(k % 2 == 0, F.create_map(F.lit("segment"), F.lit("NEW"), F.lit("extra"), k.cast("string")))
    m = cdc.merge_partial(old, new)
    return load(spark, sf_dir, "customer").select("c_custkey", *[F.try_element_at(m, F.lit(n)).alias(n) for n in ("name", "segment", "extra")])


def split_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of events in four forms as single events."""
    k = F.col("event_id")
    one, two = _text('{"n":', k, "}"), _text('{"n":', k + 1, "}")
    p = F.element_at(F.array(one, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")), F.concat(F.lit('{"events":['), one, F.lit(","), two, F.lit("]}")), F.concat(one, F.lit("\n"), two)), (k % 4 + 1).cast("int"))
    return cdc.explode_payloads(load(spark, sf_dir, "events").select("event_id", p.alias("payload"))).select("event_id", F.get_json_object("payload", "$.n").cast("long").alias("n"))


def binary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of short binary documents by their first bytes."""
    heads = ["89504E470D0A1A0A00", "FFD8FFE000", "424D00000000", "47494638396100", "255044462D312E37", "504B030400", "D0CF11E0A1B11AE100", "524946460000000057415645", "52494646000000005745425000", "0000001866747970", "00", "494433"]
    return load(spark, sf_dir, "part").select("p_partkey", files.sniff(F.unhex(_one_of(heads, F.col("p_partkey")))).alias("kind"))


def model_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model's result of every turn: how long the text is."""
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", providers.applied("length", lambda: lambda xs: [len(x) for x in xs], F.when(F.col("turn") % 3 != 0, F.col("text")), "long").alias("n"))


def kept_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "O").alias("allowed"))
    return access.audit(d, include_denied=False).select("o_orderkey")


def channel_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first channel of each order that may be used now or later."""
    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*map(F.lit, ("sms", "voice", "email")))).alias("position", "channel"))
    o = o.select("o_orderkey", "position", "channel", ((k + F.col("position")) % 4 == 0).alias("allowed"), F.when((k + F.col("position")) % 5 == 0, F.lit("2026-01-01").cast("timestamp")).alias("next_allowed"), F.array(_text("not ", F.col("channel"))).alias("reasons"))
    got = cases.channel_fallback(o, "o_orderkey")
    return got.select("o_orderkey", "channel", F.array_join("reasons", ", ").alias("reasons"))


def planned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of orders: what is to be done, or why nothing is."""
    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", _one_of(["remind", "none", "call"], k).alias("action"), _one_of(["sms", "voice"], k).alias("channel"), _one_of(["champion", "holdout", "challenger", "champion"], k).alias("arm"), F.lit("new").alias("state"), (k % 5 == 0).alias("paused"), (k % 7 == 0).alias("opted_out"), F.lit(None).cast("array<string>").alias("reasons"), F.col("o_orderdate").cast("timestamp").alias("now"))
    got = cases.plan_cases(o, ["o_orderkey", "action"], wait_minutes=30)
    return got.select("o_orderkey", "kind", "key", F.array_join("blocked", ", ").alias("blocked"), "status", F.date_format("next_eval_at", "yyyy-MM-dd HH:mm").alias("next_eval"))


QUERIES = {
    f.__name__: f
    for f in (
        document_narratives, reply_threads, record_keys, chat_event_actions, redacted_replies, output_policies, luhn_cards, truncated_state, table_chunks_ranked, new_alerts, trace_metrics, log_lines,
        access_audit, admitted_requests, address_kinds, feed_changes, feed_documents, feed_lag, feed_offsets, slot_states, records_job, documents_job, indexed_documents, approved_actions, work_items,
        tombstones, merged_updates, split_payloads, binary_kinds, model_lengths, kept_audit, channel_choice, planned_cases,
    )
}


def _luhn(x: str) -> str:
    digits = f"list_reverse(string_split({x}, ''))"
    return f"(length({x}) >= 13 AND list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[i]::INT WHEN {digits}[i]::INT > 4 THEN {digits}[i]::INT * 2 - 9 ELSE {digits}[i]::INT * 2 END)) % 10 = 0)"


def _networks() -> str:
    out = []
    for kind, nets in outbound.NETWORKS.items():
        spans = " OR ".join(f"n BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in map(ipaddress.ip_network, nets))
        out.append(f"WHEN {spans} THEN '{kind}'")
    return " ".join(out)


def _redacted(x: str) -> str:
    for pattern, mask in intents.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{mask}', 'g')"
    return x


ORACLES = {
    "document_narratives": """SELECT event_id, '[Collection: events | ID: ' || event_id || '] kind: ' || event_type || ' | gone: NULL | at.user: ' || user_id || ' | at.props.k: ' || json_extract_string(props, '$.k')
 || ' | list: [1, 2] | subs[0].a: 1 | subs[1].b: x' AS chunk FROM events""",
    "reply_threads": """WITH m AS (SELECT *, CASE WHEN turn % 4 = 3 THEN 't1' WHEN turn % 5 = 2 THEN 'm2' END AS own FROM conversations),
t AS (SELECT *, coalesce(own, 'thread_' || (row_number() OVER (PARTITION BY conv_id, own IS NULL ORDER BY turn) // 2)) AS thread FROM m)
SELECT conv_id, thread, count(*) AS turns, '[Chat: chat | Thread: ' || thread || ' | Turns: ' || count(*) || ']' || chr(10) || string_agg(role || CASE WHEN turn % 2 = 0 THEN ' (' || turn || ')' ELSE '' END || ': ' || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) AS narrative
FROM t GROUP BY 1, 2""",
    "record_keys": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_name ELSE 'h:' || left(sha256('{"id":null,"segment":"' || c_mktsegment || '","uuid":null}'), 24) END AS key,
 c_custkey || '|' || c_mktsegment AS explicit FROM customer""",
    "chat_event_actions": """SELECT event_id, ['upsert', 'delete', 'upsert', 'ignore', 'ignore', 'ignore'][event_id % 6 + 1] AS action,
 CASE event_id % 6 WHEN 0 THEN '{"type": "message", "text": "hello", "ts": "' || event_id || '"}' WHEN 2 THEN '{"ts":"' || event_id || '","text":"new"}' END AS message, CASE WHEN event_id % 6 = 1 THEN event_id::VARCHAR END AS deleted_ts FROM events""",
    "redacted_replies": f"""WITH t AS (SELECT c_custkey, 'mail ' || lower(c_name) || '@shop.example, call +91 9876543210 or (044) 555-0' || c_custkey || '12, pan abcde1234f, id 1234 5678 9012, ref INV' || (c_custkey + 1000000) || 'X' AS t FROM customer)
SELECT c_custkey, {_redacted('t')} AS text FROM t""",
    "output_policies": """WITH r AS (SELECT c_custkey, c_custkey % 3 < 2 AS raw FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'cite:citations:warn' END, CASE WHEN c_custkey % 5 <> 0 AND raw THEN 'mask:masking:block' END) AS findings, raw FROM r""",
    "luhn_cards": f"""WITH c AS (SELECT o_orderkey, (o_orderkey * 7919 + 4000000000000000)::VARCHAR AS c FROM orders) SELECT o_orderkey, {_luhn('c')} AS card, false AS short, {_luhn('c')} AS shown FROM c""",
    "truncated_state": """WITH c AS (SELECT o_orderkey AS t, o_orderstatus AS tb, o_custkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 'T' WHEN o_orderkey % 11 = 0 THEN 'D' ELSE 'U' END AS op FROM orders),
x AS (SELECT tb, max(t) AS cut FROM c WHERE op = 'T' GROUP BY 1),
l AS (SELECT c.*, row_number() OVER (PARTITION BY c.tb, k ORDER BY t DESC) AS r FROM c LEFT JOIN x USING (tb) WHERE op <> 'T' AND (cut IS NULL OR t > cut))
SELECT tb AS "table", k AS key, t AS "at" FROM l WHERE r = 1 AND op <> 'D'""",
    "table_chunks_ranked": """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS s FROM orders WHERE o_orderstatus = 'O')
SELECT s // 20 AS chunk_index, string_agg('[Table: orders | PK: ' || o_orderkey || '] o_custkey: ' || o_custkey, chr(10) ORDER BY o_orderkey) AS chunk FROM r GROUP BY 1""",
    "new_alerts": """WITH m AS (SELECT event_id, event_id % 3 AS k, CASE WHEN event_id % 3 = 1 THEN event_id % 100 / 1000.0::DOUBLE ELSE (event_id % 4000)::DOUBLE END AS value FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'latency' ELSE 'error_rate' END AS alert, value, CASE k WHEN 0 THEN 2000.0 ELSE 0.05 END::DOUBLE AS threshold FROM m WHERE event_id % 2 = 1 AND (k = 0 AND value > 2000 OR k = 1 AND value > 0.05)
UNION ALL SELECT event_id + 1000000000, 'low_confidence', event_id % 10 / 10.0::DOUBLE, 0.3::DOUBLE FROM events WHERE event_id % 10 < 3""",
    "trace_metrics": "SELECT 'm' || event_id AS event_id, 'web' AS service, event_type || '_latency_ms' AS name, (event_id % 50)::DOUBLE AS value, 'histogram' AS kind FROM events",
    "log_lines": "SELECT 'web' AS service, ['info', 'warning', 'error'][event_id % 3 + 1] AS severity, 'event ' || event_id AS message FROM events",
    "access_audit": """WITH r AS (SELECT n_nationkey % 3 AS k, ['t0', 't1', 't9'][n_regionkey % 3 + 1] AS tenant, ['read', 'write'][n_nationkey % 2 + 1] AS permission, CASE WHEN n_nationkey % 4 <> 0 THEN n_name ELSE ['reader', 'admin', 'none'][n_nationkey % 3 + 1] END AS actor FROM nation),
d AS (SELECT *, CASE WHEN k = 2 OR k = 0 AND permission = 'write' OR tenant = 't9' THEN 'deny' ELSE 'allow' END AS decision FROM r), m AS (SELECT decision, permission, count(*) AS n_metrics FROM d GROUP BY 1, 2)
SELECT actor, tenant, decision, permission, count(*) AS n, any_value(n_metrics) AS n_metrics FROM d JOIN m USING (decision, permission) GROUP BY 1, 2, 3, 4""",
    "admitted_requests": """WITH r AS (SELECT o_orderkey, ['web', 'web', 'sms', 'fax', 'tty', 'web', 'web'][o_orderkey % 7 + 1] AS c FROM orders)
SELECT o_orderkey, CASE c WHEN 'sms' THEN 'channel sms does not allow ask' WHEN 'fax' THEN 'channel fax is disabled' WHEN 'tty' THEN 'there is no channel tty' ELSE CASE WHEN o_orderkey % 4 = 3 THEN 'another tenant''s resource'
 WHEN o_orderkey % 5 = 0 THEN 'no capability ask' WHEN o_orderkey % 50 > 40 THEN 'the query has over 40 characters' WHEN o_orderkey % 6 = 0 THEN 'another principal''s session' END END AS reason FROM r""",
    "address_kinds": f"""WITH a AS (SELECT event_id, [10, 127, 172, 192, 169, 100, 8, 224, NULL, 0][event_id % 10 + 1]::BIGINT * 16777216 + event_id % 256 * 65536 + CASE WHEN event_id % 7 = 0 THEN 2 ELSE event_id % 200 END * 256 + 1 AS n FROM events)
SELECT event_id, CASE WHEN n IS NULL THEN NULL {_networks()} ELSE 'public' END AS kind FROM a""",
    "feed_changes": """WITH r AS (SELECT event_id, event_id % 4 <> 0 AS keyed, event_id % 5 <> 0 AS filled, event_type, CASE WHEN event_id % 3 = 2 THEN 'k' || event_id ELSE event_id::VARCHAR END AS k FROM events)
SELECT event_id, CASE WHEN filled THEN 'UPDATE' ELSE 'DELETE' END AS operation, 'shop' AS database, event_type AS "table", CASE WHEN keyed THEN k ELSE '0' END AS key,
 CASE WHEN filled THEN '{"id":0,"v":' || event_id % 9 || '}' WHEN event_id % 3 = 2 THEN '{"id":"' || k || '"}' ELSE '{"id":' || k || '}' END AS record FROM r WHERE filled OR keyed""",
    "feed_documents": """SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN [event_id::VARCHAR, (event_id + 1)::VARCHAR] WHEN 1 THEN ['{"a": ' || event_id || '}'] WHEN 3 THEN [event_id::VARCHAR] ELSE [] END) AS document FROM events""",
    "feed_lag": """WITH e AS (SELECT event_type AS topic, user_id % 4 AS p, min(event_id) AS low, max(event_id) + 1 AS high FROM events GROUP BY 1, 2)
SELECT topic, sum(CASE WHEN p >= 2 THEN high - low WHEN p = 1 THEN 0 ELSE greatest(0, high - low - 3) END)::BIGINT AS lag, count(*) AS partitions, count(*) FILTER (p >= 2) AS uncommitted FROM e GROUP BY 1""",
    "feed_offsets": """SELECT event_type AS topic, (user_id % 4)::INT AS partition, CASE WHEN user_id % 4 = 0 THEN greatest(1000000000, max(event_id) + 1) ELSE max(event_id) + 1 END AS "offset" FROM events WHERE user_id % 4 <> 3 GROUP BY 1, user_id % 4""",
    "slot_states": """SELECT c_custkey, 4294967296 - c_custkey * 1000 AS lag_bytes, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'lost' WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'idle' END AS state FROM customer""",
    "records_job": """WITH t AS (SELECT *, lower(concat_ws(' ', trim(p_name), trim(p_type))) AS t FROM part)
SELECT p_partkey::VARCHAR AS record_id, 'parts' AS source_job, lower(trim(p_brand)) AS brand, concat_ws('|', CASE WHEN contains(t, 'brass') THEN 'brass' END, CASE WHEN contains(t, 'steel') THEN 'steel' END) AS tags FROM t""",
    "documents_job": f"""WITH d AS (SELECT doc_id, source, md5(text) AS h, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT doc_id, source, h, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 100 THEN 1 ELSE ceil((len(ws) - 100) / 90.0)::INT + 1 END)) AS i FROM d),
c AS (SELECT *, array_to_string(ws[i * 90 + 1:i * 90 + 100], ' ') AS chunk, concat_ws(' ', source, array_to_string(ws[i * 90 + 1:i * 90 + 100], ' ')) AS text FROM i), t AS (SELECT *, {_tag_sql()} AS tags FROM c)
SELECT doc_id || ':' || i AS chunk_id, doc_id::VARCHAR AS document_id, source AS title, h AS content_hash, length(chunk)::INT AS n_chars,
 CASE WHEN list_contains(tags, 'security') THEN 'security' WHEN list_contains(tags, 'finance') THEN 'finance' WHEN list_contains(tags, 'customer') THEN 'customer' ELSE 'general' END AS classification FROM t""",
    "indexed_documents": """SELECT c_custkey::VARCHAR AS id, 'customers' AS collection, c_name || ' ' || c_mktsegment AS text, CASE WHEN c_custkey % 2 = 0 THEN '{"a":1}' ELSE '{}' END AS metadata FROM customer""",
    "approved_actions": """WITH a AS (SELECT DISTINCT 'k' || (o_orderkey // 2) AS key FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) SELECT key, 'pending' AS status FROM a WHERE key NOT LIKE '%7'""",
    "work_items": """SELECT o_orderkey::VARCHAR AS key, o_custkey::VARCHAR AS asset, CASE WHEN o_orderkey % 2 = 0 THEN 'Check pump' ELSE 'repair: ' || o_custkey END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'repair' ELSE 'drift' END AS description,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE 3 END::INT AS priority, CASE WHEN o_orderkey % 10 = 3 THEN 'OLD-' || o_orderkey ELSE 'DRY-' || upper(left(sha256(o_orderkey::VARCHAR), 10)) END AS ref, o_orderkey % 10 <> 3 AS created FROM orders""",
    "tombstones": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'UPDATE' WHEN event_id % 3 <> 0 THEN 'DELETE' ELSE 'UNKNOWN' END AS operation FROM events",
    "merged_updates": "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END AS extra FROM customer",
    "split_payloads": "SELECT event_id, unnest(CASE WHEN event_id % 4 = 0 THEN [event_id] ELSE [event_id, event_id + 1] END) AS n FROM events",
    "binary_kinds": "SELECT p_partkey, ['png', 'jpeg', 'bmp', 'gif', 'pdf', 'zip', 'ole2', 'wav', 'webp', 'mp4', NULL, 'mp3'][p_partkey % 12 + 1] AS kind FROM part",
    "model_lengths": "SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN length(text) END AS n FROM conversations",
    "kept_audit": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'",
    "channel_choice": """WITH c AS (SELECT o_orderkey, i, (o_orderkey + i) % 4 = 0 OR (o_orderkey + i) % 5 = 0 AS ok FROM orders, range(3) r(i)), b AS (SELECT o_orderkey, min(i) FILTER (ok) AS i FROM c GROUP BY 1)
SELECT o_orderkey, ['sms', 'voice', 'email'][i + 1] AS channel, CASE WHEN i IS NULL THEN 'not sms, not voice, not email' END AS reasons FROM b""",
    "planned_cases": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderdate, concat_ws(', ', CASE WHEN o_orderkey % 4 = 1 THEN 'holdout arm' END, CASE WHEN o_orderkey % 5 = 0 THEN 'case is paused' END, CASE WHEN o_orderkey % 7 = 0 THEN 'recipient opted out' END) AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = 1 THEN 'none' WHEN o_orderkey % 2 = 1 THEN 'task' ELSE 'message' END AS kind, o_orderkey || '|' || ['remind', 'none', 'call'][a + 1] AS key, b AS blocked,
 CASE WHEN a = 1 THEN 'nothing to do' WHEN b <> '' THEN 'blocked' ELSE 'pending' END AS status, strftime(o_orderdate + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS next_eval FROM o""",
}
