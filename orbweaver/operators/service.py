"""The question service: channels, keys, admission of requests, sessions, gateways."""

from __future__ import annotations

import hmac
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.operators import telemetry


class Refused(PermissionError):
    """A caller who may not do what was asked."""


@dataclass(frozen=True)
class Principal:
    user: str
    tenant: str
    role: str = "anonymous"
    permissions: tuple[str, ...] = ()


def channel_problem(channels: dict[str, dict], name: str, capability: str) -> str | None:
    """Why a channel can't be used so, or None."""
    c = channels.get(name)
    if c is None:
        return f"there is no channel {name}"
    if not c.get("enabled", True):
        return f"channel {name} is disabled"
    return None if capability in c.get("capabilities", ()) else f"channel {name} does not allow {capability}"


def _channel_reason(channels: dict[str, dict], channel: Column, capability: str) -> Column:
    out = F.concat(F.lit("there is no channel "), F.coalesce(channel, F.lit("null")))
    for name in channels:
        why = channel_problem(channels, name, capability)
        out = F.when(channel == name, F.lit(why)).otherwise(out)
    return out


def admitted(requests: DataFrame, channels: dict[str, dict], capability: str, tenant: str, most_chars: int = 0, auth: bool = True) -> DataFrame:
    """Requests (user, tenant, permissions, channel, query, session_user, session_tenant) with reason: null for those let in.

    In order: the channel, the principal's tenant and capability (while auth is on), the length of the
    query, and that a session is the principal's own. One projection; channels are configuration.
    """
    reason = F.coalesce(
        _channel_reason(channels, F.col("channel"), capability),
        F.when(F.lit(auth) & ~F.col("tenant").eqNullSafe(F.lit(tenant)), "another tenant's resource"),
        F.when(F.lit(auth) & ~F.coalesce(F.array_contains("permissions", capability), F.lit(False)), f"no capability {capability}"),
        F.when(F.lit(most_chars > 0) & (F.length("query") > most_chars), f"the query has over {most_chars} characters"),
        F.when(F.col("session_user").isNotNull() & ~(F.col("session_user").eqNullSafe(F.col("user")) & F.col("session_tenant").eqNullSafe(F.col("tenant"))), "another principal's session"),
    )
    return requests.withColumn("reason", reason)


def secret(value: str, environment: dict[str, str] | None = None) -> str:
    """A secret, or for ``env:NAME`` what the variable holds; an unset one is an error."""
    if not value.startswith("env:"):
        return value
    found = (os.environ if environment is None else environment).get(value[4:])
    if not found:
        raise Refused(f"the variable {value[4:]} is not set")
    return found


def principal_of(keys: list[dict], presented: str | None, environment: dict[str, str] | None = None) -> Principal:
    """The principal of an API key; keys are compared in constant time."""
    if not presented:
        raise Refused("no API key")
    for k in keys:
        if hmac.compare_digest(presented.encode(), secret(k["secret"], environment).encode()):
            return Principal(k["user"], k["tenant"], k.get("role", "anonymous"), tuple(k.get("permissions", ())))
    raise Refused("no such API key")


def anonymous(tenant: str, auth: bool) -> Principal:
    """The principal of callers in this process, while auth is off. It has no permissions."""
    if auth:
        raise Refused("auth is on: an API key is needed")
    return Principal("anonymous", tenant)


def authorize(principal: Principal, capability: str, tenant: str) -> None:
    """The default check: the same tenant, and the capability among the principal's own. A role's name gives nothing."""
    if principal.tenant != tenant:
        raise Refused(f"{principal.tenant} is not the resource's tenant {tenant}")
    if capability not in principal.permissions:
        raise Refused(f"no capability {capability}")


def fixed_gateway(answer: str = "No answer is configured.", decision: str = "allow") -> Callable[[str], dict]:
    """A gateway that always gives one answer, for tests and dry runs."""
    return lambda query: {"decision": decision, "answer": answer, "citations": [], "metadata": {"gateway": "fixed"}}


@dataclass
class Service:
    """Questions in, answers out, through any gateway (a function of the query, such as Client.ask)."""

    gateway: Callable[[str], dict]
    channels: dict[str, dict]
    tenant: str
    auth: bool = True
    most_chars: int = 0
    keep: int = 8
    check: Callable[[Principal, str, str], None] = authorize
    sessions: dict[str, dict] = field(default_factory=dict)

    def status(self) -> dict:
        return {"status": "ok", "tenant": self.tenant, "channels": telemetry.enabled(self.channels)}

    def _enter(self, principal: Principal, channel: str, capability: str) -> None:
        if why := channel_problem(self.channels, channel, capability):
            raise ValueError(why)
        if self.auth:
            self.check(principal, capability, self.tenant)

    def start_session(self, principal: Principal, channel: str) -> str:
        """A new session's name."""
        self._enter(principal, channel, "session")
        name = f"{principal.tenant}-{principal.user}-{len(self.sessions) + 1}"
        self.sessions[name] = {"owner": (principal.user, principal.tenant), "channel": channel, "messages": []}
        return name

    def ask(self, principal: Principal, query: str, channel: str, session: str | None = None) -> dict:
        """The gateway's answer, once channel, principal, length and session are in order; a session keeps its last messages."""
        self._enter(principal, channel, "ask")
        if 0 < self.most_chars < len(query):
            raise Refused(f"the query has over {self.most_chars} characters")
        if session is not None and self.sessions[session]["owner"] != (principal.user, principal.tenant):
            raise Refused("another principal's session")
        answer = self.gateway(query)
        if session is not None:
            s = self.sessions[session]
            s["messages"] = [*s["messages"], ("user", query), ("assistant", answer.get("answer"))][-self.keep :]
        return answer | {"channel": channel, "tenant": self.tenant, "session": session}
