"""Access checks, audit, alerts and session history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorize(requests: DataFrame, roles: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests (role, tenant, resource_tenant, permission, scope) with allowed and reason.

    The first failing check names the reason: unknown role, permission, cross-tenant, tenant scope, role
    scope. Roles (role, permissions, scopes) and tenants (tenant, scopes) are joined without a hint, so
    their size decides how. An unknown tenant is refused. A null scope is allowed.
    """
    r = roles.select("role", F.col("permissions").alias("__p"), F.col("scopes").alias("__rs"))
    t = tenants.select("tenant", F.col("scopes").alias("__ts"))
    j = requests.join(r, "role", "left").join(t, "tenant", "left")
    has = lambda scopes: F.col("scope").isNull() | F.coalesce(F.array_contains(F.col(scopes), F.col("scope")) | F.array_contains(F.col(scopes), "*"), F.lit(False))
    reason = (
        F.when(F.col("__p").isNull(), "unknown role")
        .when(~(F.array_contains("__p", F.col("permission")) | F.array_contains("__p", "*")), "missing permission")
        .when(F.col("resource_tenant").isNotNull() & (F.col("resource_tenant") != F.col("tenant")), "cross-tenant access")
        .when(F.col("__ts").isNull(), "unknown tenant")
        .when(~has("__ts"), "outside tenant scope")
        .when(~has("__rs"), "outside role scope")
    )
    return j.select(*requests.columns, reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("allowed")).alias("reason"))


def audit(decisions: DataFrame, enabled: bool = True, include_denied: bool = True) -> DataFrame:
    """The decisions that the audit log keeps."""
    return decisions.filter(F.lit(enabled) & (F.col("allowed") | F.lit(include_denied)))


def metric_alerts(metrics: DataFrame, latency_ms: float = 2000.0, error_rate: float = 0.05, name: str = "name", value: str = "value") -> DataFrame:
    """Rows whose name ends as a latency or an error rate and whose value is over the limit, with alert and threshold."""
    alert = F.when(F.col(name).endswith("latency_ms") & (F.col(value) > latency_ms), "latency").when(F.col(name).endswith("error_rate") & (F.col(value) > error_rate), "error_rate")
    limit = F.when(F.col("alert") == "latency", latency_ms).otherwise(error_rate)
    return metrics.withColumn("alert", alert).filter("alert IS NOT NULL").withColumn("threshold", limit)


def confidence_alerts(interactions: DataFrame, least: float = 0.3) -> DataFrame:
    return interactions.filter(F.col("confidence") < least).withColumn("alert", F.lit("low_confidence"))


def metric_kind(name: Column) -> Column:
    """What a metric measures, by parts of its name."""
    out = F.lit("other")
    for part, kind in reversed([("vib", "vibration"), ("temp", "temperature"), ("current", "current"), ("press", "pressure"), ("flow", "flow"), ("speed", "speed")]):
        out = F.when(F.contains(F.lower(name), F.lit(part)), kind).otherwise(out)
    return out


_CODES = {"open": "1 new wappr", "in_progress": "2 appr", "on_hold": "3 hold", "resolved": "6 resolved comp", "closed": "7 closed close"}
TICKET_STATES = {code: state for state, codes in _CODES.items() for code in codes.split()}


def ticket_state(code: Column) -> Column:
    """A vendor's state as one of five; unknown ones are in progress."""
    pairs = F.create_map(*[x for k, v in TICKET_STATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, F.lower(code.cast("string"))), F.lit("in_progress"))


def session_history(messages: DataFrame, session: str = "conv_id", order: str = "turn", n: int = 8) -> DataFrame:
    from orbweaver.operators.records import last_n

    return last_n(messages, session, order, n)


def registration_gaps(messages: DataFrame, fields: list[str]) -> DataFrame:
    """Messages with the registration fields they lack."""
    return messages.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f) == ""), F.lit(f)) for f in fields])))
