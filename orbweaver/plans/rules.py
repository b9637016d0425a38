"""Queries of rules, scorecards, strategies, experiments, contact caps, access and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import access, cases
from orbweaver.operators.decisions import DecisionTable, Scorecard, decide, run_strategy, score
from orbweaver.operators.expressions import compile_column
from orbweaver.session import load

TODAY = date(1998, 9, 2)
RULES = [
    {"id": "big", "when": "o_totalprice > 200000 and o_orderstatus in ('O', 'P')", "then": {"tier": "gold", "limit": "=o_totalprice // 1000"}, "priority": 1},
    {"id": "late", "when": "days_since(o_orderdate) > 2000", "then": {"tier": "old", "limit": 5}, "priority": 3},
    {"id": "urgent", "when": "o_orderpriority == '1-URGENT' or o_orderpriority == '2-HIGH'", "then": {"tier": "fast", "limit": 7}, "priority": 2},
]
DEFAULT = {"tier": "basic", "limit": 0}


def expressions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    e = lambda s: compile_column(s, o.schema, TODAY)
    return o.select(
        "o_orderkey",
        e("o_custkey % 7 - 3 if o_totalprice > 1e5 else -o_custkey // 4").alias("a"),
        e("0 < o_custkey < 700 and not missing").alias("b"),
        e("o_totalprice / (o_custkey % 2)").alias("c"),
        e("missing == None and missing < 3").alias("d"),
        e("len(lower(o_orderpriority)) + max(o_custkey, 100, 50)").alias("e"),
        e("coalesce(missing, o_orderstatus, 'x')").alias("f"),
    )


def _table(policy: str) -> DecisionTable:
    return DecisionTable("orders", RULES, policy, DEFAULT)


def decision_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide(load(spark, sf_dir, "orders"), _table("first"), TODAY)
    return d.select("o_orderkey", F.col("decision.tier").alias("tier"), F.col("decision.limit").alias("limit"), F.col("decision._rule").alias("rule"))


def decision_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide(load(spark, sf_dir, "orders"), _table("priority"), TODAY)
    return d.select("o_orderkey", F.col("decision.tier").alias("tier"), F.col("decision._rule").alias("rule"))


def decision_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide(load(spark, sf_dir, "orders"), _table("collect"), TODAY)
    return d.select("o_orderkey", F.array_join(F.transform("decision", lambda x: x["_rule"]), ",").alias("rules"))


CARD = Scorecard(
    "risk",
    [
        {"id": "BALANCE", "field": "c_acctbal", "bins": [{"points": 270, "when": "value < 0"}, {"points": 300, "when": "value < 5000"}, {"points": 330, "when": "value >= 5000"}], "missing_points": 290},
        {"id": "SEGMENT", "field": "c_mktsegment", "bins": [{"points": 300, "when": "value in ('BUILDING', 'MACHINERY')"}], "missing_points": 280},
        {"id": "ORDERS", "field": "n_orders", "bins": [{"when": "value > 10", "points": 40}, {"when": "True", "points": 10}], "missing_points": 0},
    ],
    bands=[("low", 640.0), ("medium", 580.0), ("high", 0.0)],
    max_reasons=2,
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    return load(spark, sf_dir, "customer").join(n, "c_custkey", "left")


def scorecard_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(_customers(spark, sf_dir), CARD, TODAY)
    return s.select("c_custkey", "score", "probability", "band", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"))


def strategy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived facts, then the scorecard, then a table that reads its score."""
    table = DecisionTable("treatment", [{"id": "call", "when": "risk_score < 600 and mean_order > 100000", "then": {"channel": "voice"}}, {"id": "mail", "when": "risk_score < 640", "then": {"channel": "email"}}], "first", {"channel": "none"})
    s = run_strategy(_customers(spark, sf_dir), {"facts": {"mean_order": "spent / n_orders"}, "steps": [{"scorecard": CARD}, {"table": table}]}, TODAY)
    return s.select("c_custkey", F.round("mean_order", 6).alias("mean_order"), "risk_score", "channel", "treatment_rule")


ARMS = {"champion": 80, "challenger": 10, "holdout": 10}


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("arm", cases.assign_arm(F.col("user_id"), "exp1", ARMS))


def experiment_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id").distinct()
    return e.select("user_id", cases.stable_bucket(F.col("user_id"), "exp1", 10_000).alias("bucket"), cases.assign_arm(F.col("user_id"), "exp1", ARMS).alias("arm"))


def wilson_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.arm_rates(_assigned(spark, sf_dir).withColumn("success", F.col("event_type") == "purchase"))


def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.compare_arms(wilson_by_arm(spark, sf_dir))


def frequency_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as requests, views and clicks as past contacts."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("channel"), F.col("ts").alias("at"))
    r = e.filter("channel = 'purchase'")
    got = cases.frequency_caps(r, e.filter("channel <> 'purchase'"), [("*", 3, 7), ("purchase", 1, 30)])
    return got.select("id", F.element_at("n_recent", 1).cast("long").alias("n_any"), "capped", F.date_format("next_allowed", "yyyy-MM-dd HH:mm:ss").alias("next_allowed"))


def case_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pair of event kinds, read as states, is an allowed move."""
    pairs = spark.createDataFrame([(a, b) for a in cases.TRANSITIONS for b in cases.TRANSITIONS], "current string, target string")
    return pairs.select("current", "target", cases.can_move(F.col("current"), F.col("target")).alias("allowed"))


def outbox_new_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a purchase whose key the outbox (even ids with a signup) lacks."""
    e = load(spark, sf_dir, "events")
    planned = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"))
    return cases.new_actions(planned, e.filter("event_type = 'signup' AND user_id % 2 = 0").select(F.col("user_id").alias("key")))


def rbac_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's request against inline roles and tenants by region."""
    roles = spark.createDataFrame([("reader", ["read"], ["*"]), ("writer", ["read", "write"], ["public"]), ("admin", ["*"], ["*"])], "role string, permissions array<string>, scopes array<string>")
    tenants = load(spark, sf_dir, "region").filter("r_regionkey < 4").select(F.concat(F.lit("t"), F.col("r_regionkey")).alias("tenant"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("public"), F.lit("internal"))).alias("scopes"))
    n = load(spark, sf_dir, "nation")
    r = n.select(
        "n_nationkey",
        F.element_at(F.array(*map(F.lit, ("reader", "writer", "admin", "ghost"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("role"),
        F.concat(F.lit("t"), F.col("n_regionkey")).alias("tenant"),
        F.concat(F.lit("t"), F.when(F.col("n_nationkey") % 5 == 0, F.lit(1)).otherwise(F.col("n_regionkey"))).alias("resource_tenant"),
        F.when(F.col("n_nationkey") % 3 == 0, "write").otherwise("read").alias("permission"),
        F.when(F.col("n_nationkey") % 2 == 0, "internal").otherwise("public").alias("scope"),
    )
    return access.authorize(r, roles, tenants).select("n_nationkey", "allowed", "reason")


def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    m = e.select("event_id", F.concat("event_type", F.when(F.col("event_type") == "error", ".error_rate").otherwise(".latency_ms")).alias("name"), F.when(F.col("event_type") == "error", F.col("value") / 1000).otherwise(F.col("value") * 20).alias("value"))
    return access.metric_alerts(m)


QUERIES = {
    f.__name__: f
    for f in (
        expressions_orders, decision_first, decision_priority, decision_collect, scorecard_customers, strategy_chain, experiment_arms, wilson_by_arm, compare_arms,
        frequency_caps, case_moves, outbox_new_actions, rbac_matrix, metric_alerts,
    )
}

_BIG = "(o_totalprice > 200000 AND o_orderstatus IN ('O', 'P'))"
_LATE = "date_diff('day', o_orderdate::DATE, DATE '1998-09-02') > 2000"
_URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_CUST = "(SELECT c.*, n_orders, spent FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1) o ON c_custkey = o_custkey)"
_PTS = f"""(SELECT *, CASE WHEN c_acctbal IS NULL THEN 290.0 WHEN c_acctbal < 0 THEN 270.0 WHEN c_acctbal < 5000 THEN 300.0 ELSE 330.0 END AS p1,
 CASE WHEN c_mktsegment IS NULL THEN 280.0 WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 300.0 ELSE 0.0 END AS p2,
 CASE WHEN n_orders IS NULL THEN 0.0 WHEN n_orders > 10 THEN 40.0 ELSE 10.0 END AS p3 FROM {_CUST})"""
_BUCKET = "(('0x' || left(sha256('exp1' || chr(31) || user_id), 16))::UBIGINT % 10000)::INT"
_ARM = f"CASE WHEN {_BUCKET} * 0.01 < 80 THEN 'champion' WHEN {_BUCKET} * 0.01 < 90 THEN 'challenger' ELSE 'holdout' END"
_WILSON = f"""(WITH a AS (SELECT {_ARM} AS arm, event_type = 'purchase' AS s FROM events), c AS (SELECT arm, count(*) FILTER (s) AS successes, count(*) AS trials FROM a GROUP BY 1),
w AS (SELECT *, successes / trials::DOUBLE AS p, 1.96 AS z, trials::DOUBLE AS n FROM c)
SELECT arm, successes, trials, round(p, 6) AS rate, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
 round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM w)"""

ORACLES = {
    "expressions_orders": """SELECT o_orderkey, CASE WHEN o_totalprice > 1e5 THEN o_custkey % 7 - 3 ELSE floor(-o_custkey / 4.0)::BIGINT END AS a, o_custkey > 0 AND o_custkey < 700 AS b,
 CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_totalprice END AS c, false AS d, length(o_orderpriority) + greatest(o_custkey, 100) AS e, o_orderstatus AS f FROM orders""",
    "decision_first": f"""SELECT o_orderkey, CASE WHEN {_BIG} THEN 'gold' WHEN {_LATE} THEN 'old' WHEN {_URGENT} THEN 'fast' ELSE 'basic' END AS tier,
 CASE WHEN {_BIG} THEN floor(o_totalprice / 1000)::DOUBLE WHEN {_LATE} THEN 5.0 WHEN {_URGENT} THEN 7.0 ELSE 0.0 END AS "limit",
 CASE WHEN {_BIG} THEN 'big' WHEN {_LATE} THEN 'late' WHEN {_URGENT} THEN 'urgent' ELSE 'default' END AS rule FROM orders""",
    "decision_priority": f"""SELECT o_orderkey, CASE WHEN {_LATE} THEN 'old' WHEN {_URGENT} THEN 'fast' WHEN {_BIG} THEN 'gold' ELSE 'basic' END AS tier,
 CASE WHEN {_LATE} THEN 'late' WHEN {_URGENT} THEN 'urgent' WHEN {_BIG} THEN 'big' ELSE 'default' END AS rule FROM orders""",
    "decision_collect": f"""SELECT o_orderkey, coalesce(nullif(array_to_string(list_filter([CASE WHEN {_BIG} THEN 'big' END, CASE WHEN {_LATE} THEN 'late' END, CASE WHEN {_URGENT} THEN 'urgent' END], lambda x: x IS NOT NULL), ','), ''), 'default') AS rules FROM orders""",
    "scorecard_customers": f"""WITH s AS (SELECT c_custkey, p1 + p2 + p3 AS score, [{{'d': 330 - p1, 'c': 'BALANCE'}}, {{'d': 300 - p2, 'c': 'SEGMENT'}}, {{'d': 40 - p3, 'c': 'ORDERS'}}] AS r FROM {_PTS})
SELECT c_custkey, score, round(1 / (1 + exp(least(700, (score - (600 - 20 / ln(2) * ln(50))) / (20 / ln(2))))), 6) AS probability, CASE WHEN score >= 640 THEN 'low' WHEN score >= 580 THEN 'medium' ELSE 'high' END AS band,
 array_to_string(list_transform(list_sort(list_transform(list_filter(r, lambda x: x.d > 0), lambda x: {{'a': -x.d, 'c': x.c}}))[1:2], lambda x: x.c), ',') AS reasons FROM s""",
    "strategy_chain": f"""WITH s AS (SELECT c_custkey, p1 + p2 + p3 AS sc, spent / n_orders AS m FROM {_PTS})
SELECT c_custkey, round(m, 6) AS mean_order, sc AS risk_score, CASE WHEN sc < 600 AND m > 100000 THEN 'voice' WHEN sc < 640 THEN 'email' ELSE 'none' END AS channel,
 CASE WHEN sc < 600 AND m > 100000 THEN 'call' WHEN sc < 640 THEN 'mail' ELSE 'default' END AS treatment_rule FROM s""",
    "experiment_arms": f"SELECT DISTINCT user_id, {_BUCKET} AS bucket, {_ARM} AS arm FROM events",
    "wilson_by_arm": f"SELECT * FROM {_WILSON}",
    "frequency_caps": """WITH r AS (SELECT * FROM events WHERE event_type = 'purchase'), h AS (SELECT * FROM events WHERE event_type <> 'purchase'),
j AS (SELECT r.event_id, list(h.ts ORDER BY h.ts) FILTER (h.ts > r.ts - INTERVAL 7 DAY) AS t FROM r LEFT JOIN h ON h.user_id = r.user_id AND h.ts <= r.ts GROUP BY 1)
SELECT event_id AS id, coalesce(len(t), 0)::BIGINT AS n_any, coalesce(len(t), 0) >= 3 AS capped, CASE WHEN len(t) >= 3 THEN strftime(t[len(t) - 2] + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') END AS next_allowed FROM j""",
    "case_moves": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(b in cases.TRANSITIONS[a]).lower()})" for a in cases.TRANSITIONS for b in cases.TRANSITIONS) + ") t(current, target, allowed)",
    "outbox_new_actions": "SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 2 = 0)",
    "rbac_matrix": """WITH r AS (SELECT n_nationkey, n_nationkey % 4 AS k, n_regionkey AS t, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE n_regionkey END AS rt, CASE WHEN n_nationkey % 3 = 0 THEN 'write' ELSE 'read' END AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'internal' ELSE 'public' END AS s FROM nation),
q AS (SELECT n_nationkey, CASE WHEN k = 3 THEN 'unknown role' WHEN k = 0 AND p = 'write' THEN 'missing permission' WHEN t <> rt THEN 'cross-tenant access' WHEN t >= 4 THEN 'unknown tenant' WHEN k = 1 AND s <> 'public' THEN 'outside role scope' ELSE 'allowed' END AS reason FROM r)
SELECT n_nationkey, reason = 'allowed' AS allowed, reason FROM q""",
    "metric_alerts": """WITH m AS (SELECT event_id, event_type || CASE WHEN event_type = 'error' THEN '.error_rate' ELSE '.latency_ms' END AS name, CASE WHEN event_type = 'error' THEN value / 1000 ELSE value * 20 END AS value FROM events)
SELECT event_id, name, value, CASE WHEN name LIKE '%error_rate' THEN 'error_rate' ELSE 'latency' END AS alert, CASE WHEN name LIKE '%error_rate' THEN 0.05 ELSE 2000.0 END AS threshold FROM m
WHERE name LIKE '%error_rate' AND value > 0.05 OR name LIKE '%latency_ms' AND value > 2000""",
}
