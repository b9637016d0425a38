"""Metrics, traces, logs and alerts as tables; access checks with their audit and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.operators import access

ALERT = ("event_id", "alert", "value", "threshold")


def alerts_of(metrics: DataFrame, latency_ms: float = 2000.0, error_rate: float = 0.05) -> DataFrame:
    """(event_id, alert, value, threshold) of metrics (event_id, name, value) over their limits."""
    return access.metric_alerts(metrics, latency_ms, error_rate).select(*ALERT)


def interaction_alerts(interactions: DataFrame, least: float = 0.3) -> DataFrame:
    """The same of interactions (event_id, confidence) below the least confidence."""
    found = access.confidence_alerts(interactions, least)
    return found.select("event_id", "alert", F.col("confidence").alias("value"), F.lit(least).alias("threshold"))


def recorded(events: DataFrame, alerts: DataFrame, events_path: str, alerts_path: str) -> None:
    """Append events and the alerts they raise to their folders."""
    events.write.mode("append").parquet(events_path)
    alerts.write.mode("append").parquet(alerts_path)


def new_alerts(metrics: DataFrame, interactions: DataFrame, known: DataFrame, latency_ms: float = 2000.0, error_rate: float = 0.05, least: float = 0.3) -> DataFrame:
    """Alerts of the whole history that are not among the ``known`` ones: an event raises an alert of a kind once."""
    found = alerts_of(metrics, latency_ms, error_rate).unionByName(interaction_alerts(interactions, least))
    return found.dropDuplicates(["event_id", "alert"]).join(known.select("event_id", "alert"), ["event_id", "alert"], "left_anti").select(*ALERT)


def traced(spans: DataFrame, event_id: Column) -> tuple[DataFrame, DataFrame]:
    """(spans, metrics) of spans (service, operation, duration_ms, trace_id): each has a latency histogram metric, which the span names."""
    rows = spans.withColumn("metric_event_id", event_id)
    metrics = rows.select(F.col("metric_event_id").alias("event_id"), "service", F.concat("operation", F.lit("_latency_ms")).alias("name"), F.col("duration_ms").cast("double").alias("value"), F.lit("histogram").alias("kind"))
    return rows, metrics


SEVERITIES = ("debug", "info", "warning", "error", "critical")


def log_rows(messages: DataFrame, service: str = "service", severity: str = "severity", message: str = "message") -> DataFrame:
    """Log rows with a known severity in lower case; an unknown one is an error of the caller."""
    low = F.lower(F.col(severity))
    known = F.coalesce(low.isin(*SEVERITIES), F.lit(False))
    return messages.select(F.col(service).alias("service"), F.when(known, low).otherwise(F.raise_error(F.concat(F.lit("no severity: "), F.coalesce(low, F.lit("null"))))).alias("severity"), F.col(message).alias("message"))


def checked_access(requests: DataFrame, roles: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, audit rows, telemetry rows) of access requests; an audit row names the subject, else the role."""
    decisions = access.authorize(requests, roles, tenants)
    decision = F.when(F.col("allowed"), "allow").otherwise("deny")
    actor = F.coalesce(F.col("subject"), F.col("role")) if "subject" in requests.columns else F.col("role")
    audit = decisions.select(F.lit("access.check").alias("event_type"), actor.alias("actor"), "tenant", decision.alias("decision"), "permission", "reason", "allowed")
    telemetry = decisions.select(F.lit("access_check").alias("metric"), F.lit(1.0).alias("value"), decision.alias("decision"), "permission")
    return decisions, audit, telemetry


EXPORTERS = ("opentelemetry", "prometheus", "grafana", "datadog", "splunk", "cloudwatch")


def exporter_issues(exporters: dict[str, dict], environment: dict[str, str]) -> list[str]:
    """What is wrong with exporters (type, enabled, endpoint, api_key_env), in their order."""
    out = []
    for name, e in exporters.items():
        on = e.get("enabled", False)
        if e.get("type") not in EXPORTERS:
            out.append(f"{name}: {e.get('type')} is no type of exporter")
        if on and not e.get("endpoint"):
            out.append(f"{name}: an enabled exporter needs an endpoint")
        if on and e.get("api_key_env") and not environment.get(e["api_key_env"]):
            out.append(f"{name}: the variable {e['api_key_env']} with its key is not set")
    return out


def enabled(named: dict[str, dict]) -> list[str]:
    """Sorted names of what is enabled: exporters, channels."""
    return sorted(n for n, x in named.items() if x.get("enabled", True))
