"""Window statistics, trends and sensor assessment in batch."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping
from dataclasses import dataclass, field
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECENT, HISTORY, STEP = 120, 288, 300.0
FAST, SLOW = 900.0, 43_200.0


def window_stats(df: DataFrame, keys: list[str], time: str, value: str, seq: str, size: str = "10 minutes") -> DataFrame:
    """Tumbling windows: start, n, mean (4 places), min, max and the last value in input order."""
    g = df.groupBy(*keys, F.window(time, size).alias("w"))
    g = g.agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, seq).alias("last"))
    return g.select(*keys, F.col("w.start").alias("start"), "n", "mean", "min", "max", "last")


def slopes(df: DataFrame, keys: list[str], time: str, value: str, least: int = 10, significance: float = 4.0) -> DataFrame:
    """Least-squares slope per hour of each key, and whether it is significant; null below ``least`` points.

    All sums aggregate before the shuffle.
    """
    t = F.unix_micros(F.col(time)) / 3.6e9 if dict(df.dtypes)[time] == "timestamp" else F.unix_micros(F.col(time).cast("timestamp")) / 3.6e9
    d = df.select(*keys, t.alias("x"), F.col(value).alias("y")).filter("y IS NOT NULL")
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy"))
    se = F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))
    ok = (F.col("n") >= least) & (F.col("sxx") > 0)
    return g.select(*keys, "n", F.when(ok, F.round("b", 6)).alias("slope_per_hour"), F.when(ok, (se == 0) | (F.abs(F.col("b")) / F.when(se != 0, se) >= significance)).alias("significant"))


def diagnose(symptoms: DataFrame, faults: list[dict[str, Any]], key: str = "asset", col: str = "symptoms") -> DataFrame:
    """(key, fault, confidence): the most specific fault whose required symptoms are all there; sensor faults first."""
    ranked = []
    for f in faults:
        need = F.array(*[F.lit(x) for x in f["requires"]])
        n = len(f["requires"])
        support = F.size(F.array_intersect(F.col(col), F.array(*[F.lit(x) for x in f.get("supports", [])]))) / len(f["supports"]) if f.get("supports") else F.lit(0.0)
        conf = F.least(F.lit(0.95), support * 0.3 + (0.55 + (n - 1) / 10))
        row = F.struct(F.lit(0 if f.get("sensor") else 1).alias("o"), F.lit(-n).alias("n"), (-conf).alias("c"), F.lit(f["name"]).alias("fault"))
        ranked.append(F.when(F.size(F.array_except(need, F.col(col))) == 0, row))
    best = F.array_min(F.array_compact(F.array(*ranked)))
    return symptoms.withColumn("__b", best).select(key, F.col("__b.fault").alias("fault"), F.round(-F.col("__b.c"), 4).alias("confidence"))


Limit = float | None


@dataclass
class Signal:
    """What is known of a metric: limits, plausible range, rates and weights."""

    name: str
    alarm_high: Limit = None
    alarm_low: Limit = None
    warn_high: Limit = None
    warn_low: Limit = None
    valid_max: Limit = None
    valid_min: Limit = None
    max_rate_per_hour: Limit = None
    flatline_minutes: float = 30.0
    expected_interval_seconds: float = 60.0
    drift_threshold: float = 3.0
    z_threshold: float = 6.0
    weight: float = 1.0
    unit: str = ""


def logistic(x: float, middle: float, steep: float = 1.5) -> float:
    return 1 / (1 + math.exp(-steep * (x - middle)))


def significant_slope(points: list[tuple[float, float]], least: int = 10, significance: float = 4.0) -> float | None:
    """Slope per hour of (seconds, value), or None where it is not clear of its error."""
    n = len(points)
    if n < least:
        return None
    mt, mv = sum(t for t, _ in points) / n / 3600, sum(v for _, v in points) / n
    sxx = sum((t / 3600 - mt) ** 2 for t, _ in points)
    if sxx <= 0:
        return None
    b = sum((t / 3600 - mt) * (v - mv) for t, v in points) / sxx
    rss = sum((v - mv - b * (t / 3600 - mt)) ** 2 for t, v in points)
    se = math.sqrt(rss / (n - 2) / sxx)
    return b if se == 0 or abs(b) / se >= significance else None


@dataclass
class Series:
    """Bounded state of one metric: recent points, a thinned day of history, and two time-aware averages."""

    points: list[tuple[float, float]] = field(default_factory=list)
    history: list[tuple[float, float]] = field(default_factory=list)
    fast: float | None = None
    slow: float | None = None
    var: float = 0.0
    last: float | None = None
    invalid: bool = False

    def add(self, t: float, v: float | None, s: Signal) -> None:
        """Take a reading. Null is skipped; NaN or an implausible value marks the metric until a good one comes."""
        if v is None:
            return
        bounds = (s.valid_min, -math.inf), (s.valid_max, math.inf)
        low, high = (limit if given is None else given for given, limit in bounds)
        self.invalid = not (math.isfinite(v) and low <= v <= high)
        if self.invalid:
            return
        self.points = [*self.points, (t, v)][-RECENT:]
        if not self.history or t - self.history[-1][0] >= STEP:
            self.history = [*self.history, (t, v)][-HISTORY:]
        self._average(v, 0.0 if self.last is None else max(0.0, t - self.last))
        self.last = t

    def _average(self, v: float, passed: float) -> None:
        """Move both averages towards ``v`` by the time that passed; the first reading sets them."""
        if self.slow is None or self.fast is None:
            self.slow = self.fast = v
            return
        keep = math.exp(-passed / SLOW)
        gap = v - self.slow
        self.var = keep * (self.var + (1 - keep) * gap * gap)
        self.slow += (1 - keep) * gap
        self.fast = v + math.exp(-passed / FAST) * (self.fast - v)

    def dump(self) -> dict[str, Any]:
        r = lambda ps: [[float(int(t)), round(v, 4)] for t, v in ps]
        return {"points": r(self.points), "history": r(self.history), "var": self.var, "slow": self.slow, "fast": self.fast, "last": self.last, "invalid": self.invalid}

    @classmethod
    def load(cls, d: Mapping[str, Any]) -> Series:
        return cls([(t, v) for t, v in d["points"]], [(t, v) for t, v in d["history"]], d["fast"], d["slow"], d["var"], d["last"], d["invalid"])


def assess(series: dict[str, Series], signals: dict[str, Signal], now: float, horizon_hours: float = 72.0) -> dict[str, Any]:
    """Anomaly score, failure risk, data quality, the leading signal, time to a limit, and reason codes."""
    quality, reasons, scores, soonest, alarm = "valid", [], [], None, False
    for name, sig in signals.items():
        s, up = series.get(name) or Series(), name.upper()
        if s.invalid:
            quality = "invalid"
            reasons.append((f"{up}_SENSOR_FAULT", 0.0))
            continue
        if not s.points:
            continue
        end = s.points[-1][0]
        value = median(v for _, v in s.points[-3:])
        if now - end > max(5 * sig.expected_interval_seconds, 300):
            quality = "suspect" if quality == "valid" else quality
            reasons.append((f"{up}_STALE", 0.0))
        flat = [v for t, v in s.points if t >= end - sig.flatline_minutes * 60]
        if len(flat) >= 10 and len(set(flat)) == 1 and any(v != flat[0] for _, v in s.points + s.history):
            quality = "suspect" if quality == "valid" else quality
            reasons.append((f"{up}_FLATLINE", 0.0))
        found: list[tuple[float, str]] = []
        for side, warn, limit, beyond in (("HIGH", sig.warn_high, sig.alarm_high, lambda x: value >= x), ("LOW", sig.warn_low, sig.alarm_low, lambda x: value <= x)):
            if limit is not None and beyond(limit):
                found.append((1.0, f"ALARM_{side}"))
                alarm = True
            elif warn is not None and beyond(warn):
                found.append((0.6, f"WARN_{side}"))
        known = len(s.history)
        old = [] if known <= 24 else [v for t, v in s.history if t + 3600 < end]
        if old:
            mid = median(old)
            mad = 1.4826 * median(abs(v - mid) for v in old)
            if mad > 0 and (z := abs(value - mid) / mad) >= 0.7 * sig.z_threshold:
                found.append((logistic(z, sig.z_threshold), "SPIKE"))
        if known >= 24 and s.var > 0 and abs(d := (s.fast - s.slow) / s.var**0.5) >= 0.7 * sig.drift_threshold:
            found.append((logistic(abs(d), sig.drift_threshold), "DRIFT"))
        times = [t for t, _ in s.points]
        slope = significant_slope(s.points[bisect_left(times, end - 3 * 3600) :] if times == sorted(times) else [p for p in s.points if p[0] >= end - 3 * 3600])
        if slope is not None:
            if sig.max_rate_per_hour and abs(slope) > sig.max_rate_per_hour:
                found.append((logistic(abs(slope) / sig.max_rate_per_hour, 1.5, 3.0), "FAST_CHANGE"))
            limit = sig.alarm_high if slope > 0 else sig.alarm_low
            if limit is not None and slope and (hours := (limit - value) / slope) >= 0:
                soonest = hours if soonest is None else min(soonest, hours)
        if found and (best := max(found))[0] >= 0.3:
            reasons.append((f"{up}_{best[1]}", round(best[0], 4)))
            scores.append((best[0], sig.weight, name))
    calm = 1.0
    for score, weight, _ in scores:
        calm *= 1 - min(1.0, score * weight)
    anomaly = 1 - calm
    risk = max(1.0 if alarm else 0.0, 0.6 * anomaly, 1 - soonest / horizon_hours if soonest is not None and soonest <= horizon_hours else 0.0)
    return {
        "anomaly_score": round(anomaly, 4),
        "failure_risk": round(risk, 4),
        "data_quality": quality,
        "top_signal": max(scores)[2] if scores else None,
        "time_to_limit_hours": None if soonest is None else round(soonest, 2),
        "reasons": [c for c, _ in reasons],
    }


ASSESSMENT = "anomaly_score double, failure_risk double, data_quality string, top_signal string, time_to_limit_hours double, reasons array<string>"


def assess_batch(readings: DataFrame, signals: dict[str, Signal], asset: str = "asset", metric: str = "metric", time: str = "ts", value: str = "value", seq: str = "seq") -> DataFrame:
    """One assessment an asset, at its latest reading.

    State is bounded (RECENT and HISTORY points a metric), so readings stream through in time order
    and no asset's readings are held as a whole.
    """
    kind = readings.schema[asset].dataType.simpleString()

    def run(batches):
        current, state, now, out = None, {}, 0.0, []
        for pdf in batches:
            for a, m, t, v in zip(pdf["asset"], pdf["metric"], pdf["t"], pdf["v"], strict=True):
                if current is None or a != current[0]:
                    if current is not None:
                        out.append({asset: current[0]} | assess(state, signals, now))
                    current, state = (a,), {}
                now = t
                if m in signals:
                    state.setdefault(m, Series()).add(t, None if v is None or (isinstance(v, float) and pd.isna(v)) else float(v), signals[m])
            if len(out) > 500:
                yield pd.DataFrame(out)
                out = []
        if current is not None:
            out.append({asset: current[0]} | assess(state, signals, now))
        if out:
            yield pd.DataFrame(out)

    r = readings.filter(F.col(asset).isNotNull()).select(F.col(asset).alias("asset"), F.col(metric).alias("metric"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"), F.col(value).cast("double").alias("v"), F.col(seq).alias("s"))
    return r.repartition("asset").sortWithinPartitions("asset", "t", "s").drop("s").mapInPandas(run, f"`{asset}` {kind}, {ASSESSMENT}")
