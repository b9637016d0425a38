"""Cases, contact policy, experiments and planning."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 10_000
#: Where a case may go from each state.
_ALL = tuple("closed resolved escalated awaiting_approval promised contacted monitoring".split())
TRANSITIONS = {
    "open": set(_ALL) - {"promised"},
    "monitoring": set(_ALL) - {"monitoring", "promised"},
    "contacted": set(_ALL) - {"contacted"},
    "promised": set(_ALL) - {"promised"},
    "awaiting_approval": set(_ALL) - {"awaiting_approval"},
    "escalated": set(_ALL) - {"escalated", "promised"},
    "resolved": {"monitoring", "closed"},
    "closed": set(),
}


def can_move(current: Column, target: Column, transitions: dict[str, set[str]] | None = None) -> Column:
    """Whether a case may go from one state to another."""
    table = TRANSITIONS if transitions is None else transitions
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in sorted(table.items()) for b in sorted(bs)])
    return F.coalesce(F.array_contains(pairs, F.concat(current, F.lit(">"), target)), F.lit(False))


def stable_bucket(subject: Column, experiment: str, buckets: int = 100) -> Column:
    """A bucket from the first 8 bytes of SHA-256 of experiment and subject."""
    digest = F.left(F.sha2(F.concat(F.lit(f"{experiment}\x1f"), subject.cast("string")).cast("binary"), 256), F.lit(16))
    return (F.conv(digest, 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def assign_arm(subject: Column, experiment: str, arms: dict[str, float]) -> Column:
    """An arm by weights, the same for the same subject every time."""
    total = sum(w for _, w in arms.items())
    if not total > 0:
        raise ValueError("the weights of the arms add up to nothing")
    point = stable_bucket(subject, experiment, BUCKETS) * (total / BUCKETS)
    names = list(arms)
    out, upto = F.lit(names[-1]), total
    for name in reversed(names):
        out = F.when(point < upto, F.lit(name)).otherwise(out)
        upto -= arms[name]
    return out


Z = {0.9: 1.6449, 0.95: 1.96, 0.99: 2.5758}


def wilson(successes: Column, trials: Column, confidence: float = 0.95) -> dict[str, Column]:
    """rate, low and high of a proportion by Wilson's score interval; null without trials."""
    # the bounds are the roots of (n + zz) x^2 - (2 s + zz) x + s^2 / n
    zz = Z.get(round(confidence, 2), Z[0.95]) ** 2
    n = F.when(trials > 0, trials.cast("double"))
    s = F.least(F.greatest(successes, F.lit(0)), trials)
    root = F.sqrt(zz * (zz + 4 * s * (n - s) / n))
    at = lambda sign: (2 * s + zz + sign * root) / (2 * (n + zz))
    return {"rate": F.round(s / n, 6), "low": F.round(F.greatest(at(-1), F.lit(0.0)), 6), "high": F.round(F.least(at(1), F.lit(1.0)), 6)}


def arm_rates(outcomes: DataFrame, arm: str = "arm", success: str = "success", confidence: float = 0.95) -> DataFrame:
    """(arm, successes, trials, rate, low, high)."""
    counts = outcomes.groupBy(arm).agg(F.sum(F.col(success).cast("long")).alias("successes"), F.count("*").alias("trials"))
    return counts.withColumns(wilson(F.col("successes"), F.col("trials"), confidence))


@F.pandas_udf(T.DoubleType())
def normal_tail(x: pd.Series) -> pd.Series:
    """P(Z > x); there is no erfc among the built-in functions."""
    return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2)))


def compare_arms(rates: DataFrame, control: str = "holdout", confidence=0.95, least: int = 30, arm: str = "arm") -> DataFrame:
    """Each arm against the control: lift, relative_lift, p_value, interval of the difference, conclusive, note.

    ``rates`` is arm_rates' result: a row an arm, so the control's row is broadcast.
    """
    c = rates.filter(F.col(arm) == control).select(*[F.col(x).alias(f"c_{x}") for x in ("successes", "trials", "rate")]).limit(1)
    j = rates.filter(F.col(arm) != control).crossJoin(F.broadcast(c))
    n, m, p, q = F.col("trials"), F.col("c_trials"), F.col("rate"), F.col("c_rate")
    pooled = (F.col("successes") + F.col("c_successes")) / (n + m)
    se0 = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    se = F.sqrt(p * (1 - p) / n + q * (1 - q) / m)
    z = Z.get(round(confidence, 2), Z[0.95])
    j = j.withColumn("diff", p - q).withColumn("p_value", F.when(se0 == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(F.abs(p - q) / F.when(se0 != 0, se0)))))
    enough, clear = F.least(n, m) >= least, F.col("p_value") < 1 - confidence
    return j.select(
        arm,
        F.round("diff", 6).alias("lift"),
        F.round(F.when(q > 0, F.col("diff") / q), 6).alias("relative_lift"),
        F.round("p_value", 6).alias("p_value"),
        F.round(F.col("diff") - z * se, 6).alias("diff_low"),
        F.round(F.col("diff") + z * se, 6).alias("diff_high"),
        (enough & clear).alias("conclusive"),
        F.when(~enough, f"needs at least {least} trials per arm before drawing conclusions").when(clear, "difference is statistically significant").otherwise("no significant difference yet").alias("note"),
    )


@dataclass
class ContactPolicy:
    """Hours (channel or * to start and end hour), caps (channel or *, most, days), consent, DND, cool-off days."""

    hours: dict[str, tuple[int, int]] = field(default_factory=dict)
    cooloff_days: dict[str, int] = field(default_factory=dict)
    caps: list[tuple[str, int, int]] = field(default_factory=list)
    timezone: str = "UTC"
    require_consent: tuple = ()
    respect_dnd: tuple = tuple("whatsapp voice sms".split())


PRESETS = {
    "IN_RBI": ContactPolicy(hours={"*": (8, 19)}, caps=[("voice", 3, 7), ("sms", 2, 1), ("whatsapp", 2, 1), ("*", 6, 7)], require_consent=("whatsapp",), timezone="Asia/Kolkata"),
    "US_REG_F": ContactPolicy(hours={"*": (8, 21)}, caps=[("voice", 7, 7)], cooloff_days={"voice": 7}, timezone="America/New_York"),
}


def frequency_caps(requests: DataFrame, history: DataFrame, caps: list[tuple[str, int, int]], subject: str = "subject", channel: str = "channel", at: str = "at") -> DataFrame:
    """(request columns, n_recent, capped, next_allowed): contacts of the past against caps (channel, most, days).

    A contact counts while it is strictly newer than the request less the period. '*' spans channels.
    Past contacts are joined by subject once, those inside the longest period only, and counted for all
    caps together; a request gathers its subject's contacts of that period and no others.
    """
    r = requests.withColumn("__id", F.monotonically_increasing_id())
    h = history.select(F.col(subject).alias("__s"), F.col(channel).alias("__c"), F.col(at).alias("__t"))
    longest = F.expr(f"interval {max((days for _, _, days in caps), default=0)} days")
    j = r.join(h, (r[subject] == h["__s"]) & (F.col("__t") <= F.col(at)) & (F.col("__t") > F.col(at) - longest), "left")
    aggs = []
    for i, (c, _, days) in enumerate(caps):
        mine = (F.lit(c) == "*") | (F.col("__c") == c)
        recent = F.col("__t") > F.col(at) - F.expr(f"interval {days} days")
        aggs.append(F.array_sort(F.collect_list(F.when(mine & recent, F.col("__t")))).alias(f"__t{i}"))
    g = j.groupBy("__id", *[F.col(x) for x in requests.columns]).agg(*aggs)
    hit, nexts = [], []
    for i, (c, most, days) in enumerate(caps):
        n = F.size(f"__t{i}")
        over = (n >= most) & ((F.lit(c) == "*") | (F.col(channel) == c))
        hit.append(over)
        nexts.append(F.when(over, F.try_element_at(F.col(f"__t{i}"), (n - most + 1).cast("int")) + F.expr(f"interval {days} days")))
    capped = hit[0]
    for x in hit[1:]:
        capped = capped | x
    return g.select(*requests.columns, F.array(*[F.size(f"__t{i}") for i in range(len(caps))]).alias("n_recent"), capped.alias("capped"), F.array_max(F.array_compact(F.array(*nexts))).alias("next_allowed"))


def contact_check(df: DataFrame, policy: ContactPolicy, channel: str = "channel", now: str = "now", tz: str | None = None, consent: str | None = None, dnd: str | None = None, last_talk: str | None = None) -> DataFrame:
    """``df`` with reasons, allowed and next_allowed for all checks but caps (see frequency_caps)."""
    zone = F.coalesce(F.col(tz), F.lit(policy.timezone)) if tz else F.lit(policy.timezone)
    local = F.from_utc_timestamp(F.col(now), zone)
    reasons, waits, never = [], [], []
    ch = F.col(channel)
    for c, (a, b) in sorted(policy.hours.items(), reverse=True):
        mine = (ch == c) if c != "*" else ~ch.isin(*[x for x in policy.hours if x != "*"]) if len(policy.hours) > 1 else F.lit(True)
        out = mine & ((F.hour(local) < a) | (F.hour(local) >= b))
        reasons.append(F.when(out, F.lit(f"outside contact hours {a:02d}:00-{b:02d}:00")))
        day = F.date_trunc("day", local) + F.make_dt_interval(F.when(F.hour(local) < a, 0).otherwise(1)) + F.expr(f"interval {a} hours")
        waits.append(F.when(out, F.to_utc_timestamp(day, zone)))
    if policy.require_consent:
        no = ch.isin(*policy.require_consent) & (~F.coalesce(F.col(consent), F.lit(False)) if consent else F.lit(True))
        reasons.append(F.when(no, F.concat(F.lit("no recorded consent for "), ch)))
        never.append(no)
    if dnd:
        no = F.coalesce(F.col(dnd), F.lit(False)) & ch.isin(*policy.respect_dnd)
        reasons.append(F.when(no, F.concat(F.lit("recipient is on do-not-disturb for "), ch)))
        never.append(no)
    for c, days in policy.cooloff_days.items() if last_talk else ():
        end = F.col(last_talk) + F.expr(f"interval {days} days")
        soon = (ch == c) & (F.col(now) < end)
        reasons.append(F.when(soon, F.lit(f"within {days}-day cooling period after a conversation")))
        waits.append(F.when(soon, end))
    found = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    block = F.lit(False)
    for n in never:
        block = block | n
    later = F.array_max(F.array_compact(F.array(*waits))) if waits else F.lit(None).cast("timestamp")
    return df.withColumn("reasons", found).withColumn("allowed", F.size("reasons") == 0).withColumn("next_allowed", F.when(~block, later))


def plan_cases(cases: DataFrame, key_parts: list[str], holdout_arms: tuple[str, ...] = ("holdout",), wait_minutes: int = 15) -> DataFrame:
    """Plans from cases with action, channel, arm, state, paused, opted_out, reasons and now.

    Adds kind (none, task, message), key, blocked (reasons in order), status, next_state and next_eval_at.
    """
    from orbweaver.operators.enrich import idempotency_key

    action, channel = F.col("action"), F.col("channel")
    kind = F.when(action.isNull() | (action == "none"), "none").when(channel.isin("voice", "visit"), "task").otherwise("message")
    blocked = F.array_compact(F.array(F.when(F.col("arm").isin(*holdout_arms), "holdout arm"), F.when(F.col("paused"), "case is paused"), F.when(F.col("opted_out"), "recipient opted out")))
    out = cases.withColumn("kind", kind).withColumn("key", idempotency_key([F.col(k) for k in key_parts])).withColumn("blocked", F.concat(blocked, F.coalesce("reasons", F.array().cast("array<string>"))))
    status = F.when(F.col("kind") == "none", "nothing to do").when(F.size("blocked") > 0, "blocked").when(F.coalesce(F.col("needs_approval"), F.lit(False)) if "needs_approval" in cases.columns else F.lit(False), "needs_approval").otherwise("pending")
    target = F.when(status == "pending", "contacted").when(status == "needs_approval", "awaiting_approval")
    return out.withColumn("status", status).withColumn("next_state", F.when(target.isNotNull() & can_move(F.col("state"), target), target).otherwise(F.col("state"))).withColumn("next_eval_at", F.col("now") + F.expr(f"interval {max(15, wait_minutes)} minutes"))


def channel_fallback(candidates: DataFrame, case: str, position: str = "position", allowed: str = "allowed", next_allowed: str = "next_allowed", reasons: str = "reasons") -> DataFrame:
    """(case, channel, reasons): the first channel that may be used now or later, else all reasons."""
    usable = F.col(allowed) | F.col(next_allowed).isNotNull()
    best = F.min_by(F.when(usable, F.col("channel")), F.when(usable, F.col(position)))
    why = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(reasons).alias("r")))), lambda x: x["r"]))
    return candidates.groupBy(case).agg(best.alias("channel"), why.alias("__r")).withColumn("reasons", F.when(F.col("channel").isNull(), F.col("__r"))).drop("__r")


def new_actions(planned: DataFrame, outbox: DataFrame, key: str = "key") -> DataFrame:
    """Planned actions whose key the outbox does not have, each key once."""
    return planned.dropDuplicates([key]).join(outbox.select(key).distinct(), key, "left_anti")


def due(cases: DataFrame, now: Column) -> DataFrame:
    """Cases whose time of evaluation has come; a case never evaluated is due."""
    return cases.filter(F.col("next_eval_at").isNull() | (F.col("next_eval_at") <= now))


def upsert(current: DataFrame, incoming: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Current rows with incoming facts laid over them, and whether any changed (changed rows are due at once)."""
    c = current.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in facts], F.lit(True).alias("__old"))
    i = incoming.select(F.col(key), *facts, F.lit(True).alias("__new"))
    j = c.join(i, key, "full_outer")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return j.select(key, *[F.when(F.col("__new"), F.col(f)).otherwise(F.col(f"__{f}")).alias(f) for f in facts], (F.coalesce("__new", F.lit(False)) & ~(F.coalesce("__old", F.lit(False)) & same)).alias("changed"))


def approved(actions: DataFrame, outbox: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, new outbox rows) once the cases of ``subjects`` are approved.

    Actions (subject, key, kind, needs_approval, sendable) of these cases no longer need approval and are
    queued, each key once; a key that the outbox has is not queued again.
    """
    named = subjects.select("subject").distinct().withColumn("__ok", F.lit(True))
    j = actions.join(named, "subject", "left").withColumn("released", F.coalesce(F.col("__ok"), F.lit(False)) & F.col("needs_approval") & F.col("sendable")).drop("__ok")
    out = j.withColumn("needs_approval", F.col("needs_approval") & ~F.col("released"))
    queued = new_actions(j.filter("released"), outbox).select("subject", "key", "kind", F.lit("pending").alias("status"))
    return out, queued


def work_items(actions: DataFrame, outputs: Column) -> DataFrame:
    """(key, asset, title, description, priority) of actions (subject, action, key) from a map of their decision's outputs."""
    said = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(outputs, F.lit(n)), F.lit("")) for n in names])
    title = F.coalesce(said("title"), F.concat_ws(": ", "action", "subject"))
    return actions.select("key", F.col("subject").alias("asset"), title.alias("title"), F.coalesce(said("description", "reason"), F.col("action")).alias("description"), F.coalesce(said("work_priority").try_cast("int"), F.lit(3)).alias("priority"))


def submitted(items: DataFrame, known: DataFrame) -> DataFrame:
    """A dry run of a ticket system: (key, ref, created): an item whose key is known gets that ticket, others a new one."""
    j = items.dropDuplicates(["key"]).join(known.select("key", F.col("ref").alias("__ref")), "key", "left")
    ref = F.concat(F.lit("DRY-"), F.upper(F.left(F.sha2(F.col("key").cast("binary"), 256), F.lit(10))))
    return j.select("key", F.coalesce("__ref", ref).alias("ref"), F.col("__ref").isNull().alias("created"))
