"""Decision tables, scorecards and strategies, compiled to one projection each."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from hashlib import sha256
from math import log
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweaver.operators.expressions import Compiler, Typed, fields, parse

HIT_POLICIES = tuple("collect first priority unique".split())


def content_version(data: Any, size: int = 16) -> str:
    """A hash of what a rule set says, the same for equal rules."""
    return sha256(json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()[:size]


@dataclass
class DecisionTable:
    """Rules (id, when, then, priority) under a hit policy; outputs that start with '=' are expressions."""

    name: str
    rules: list[dict]
    hit_policy: str = HIT_POLICIES[1]
    default: dict | None = None
    inputs: tuple = ()

    def __post_init__(self) -> None:
        if self.hit_policy not in set(HIT_POLICIES):
            raise ValueError(f"a hit policy is one of {HIT_POLICIES}")
        self.rules = [{"id": r.get("id") or f"R{i}", "when": r.get("when") or "True", "then": r.get("then") or {}, "priority": r.get("priority") or 0} for i, r in enumerate(self.rules, 1)]
        ids = [r["id"] for r in self.rules]
        if len(set(ids)) < len(ids):
            raise ValueError(f"rule ids repeat in {self.name}")
        for r in self.rules:
            parse(r["when"])
            for v in r["then"].values():
                if isinstance(v, str) and v.startswith("="):
                    parse(v[1:])

    @property
    def version(self) -> str:
        return content_version({"name": self.name, "rules": self.rules, "hit_policy": self.hit_policy, "default": self.default, "inputs": self.inputs})

    def reads(self) -> set[str]:
        """All facts that the table looks at: what a scan has to deliver."""
        exprs = [r["when"] for r in self.rules] + [v[1:] for r in self.rules for v in r["then"].values() if isinstance(v, str) and v.startswith("=")]
        return set(self.inputs).union(*map(fields, exprs)) if exprs else set(self.inputs)

    def _outputs(self, then: dict[str, Any], rule: str, names: list[str], c: Compiler, kinds: dict[str, T.DataType]) -> Column:
        def one(name: str) -> Column:
            v = then.get(name)
            col = c.compile(v[1:]).col if isinstance(v, str) and v.startswith("=") else F.lit(v)
            return col.cast(kinds[name]).alias(name)

        return F.struct(*map(one, names), F.lit(rule).alias("_rule"))

    def column(self, schema: T.StructType, today: date) -> Column:
        """The table's outputs: one struct (first, priority, unique) or an array of them (collect)."""
        c = Compiler(schema, today)
        thens = [(r["id"], r["then"]) for r in self.rules] + ([("default", self.default)] if self.default is not None else [])
        names = list(dict.fromkeys(k for _, t in thens for k in t))
        kinds: dict[str, T.DataType] = {}
        for _, t in thens:
            for k, v in t.items():
                got = c.compile(v[1:]) if isinstance(v, str) and v.startswith("=") else c._constant(_Const(v))
                if got.type is not None and kinds.get(k) is None:
                    kinds[k] = got.type
                elif got.type is not None and str(kinds[k]) != str(got.type):
                    kinds[k] = T.DoubleType() if got.kind == "number" and isinstance(kinds[k], T.NumericType) else T.StringType()
        kinds = {k: kinds.get(k) or T.StringType() for k in names}
        outs = [(c.condition(r["when"]), self._outputs(r["then"], r["id"], names, c, kinds), r) for r in self.rules]
        other = self._outputs(self.default, "default", names, c, kinds) if self.default is not None else F.lit(None)
        if self.hit_policy in ("first", "priority"):
            order = outs if self.hit_policy == "first" else sorted(outs, key=lambda o: -o[2]["priority"])  # stable: the first of equals wins
            result = other
            for test, out, _ in reversed(order):
                result = F.when(test, out).otherwise(result)
            return result
        hits = F.array_compact(F.array(*[F.when(test, out) for test, out, _ in outs]))
        if self.hit_policy == "collect":
            return F.when(F.size(hits) > 0, hits).otherwise(F.array(other) if self.default is not None else hits)
        one = F.when(F.size(hits) > 1, F.raise_error(F.lit(f"more than one rule of {self.name} matched"))).otherwise(F.try_element_at(hits, F.lit(1)))
        return F.coalesce(one, other) if self.default is not None else one


class _Const:
    def __init__(self, value: Any) -> None:
        self.value = value


@dataclass
class Scorecard:
    """Points by characteristic, scaled so that ``pdo`` points double the odds."""

    name: str
    characteristics: list[dict]
    bands: list = field(default_factory=list)
    outputs: dict = field(default_factory=dict)
    max_reasons: int = 4
    pdo: float = 20
    base_odds: float = 50
    base_points: float = 600

    def __post_init__(self) -> None:
        if not self.characteristics or self.pdo <= 0 or self.base_odds <= 0:
            raise ValueError("a scorecard has characteristics, and positive pdo and base_odds")
        least = [m for _, m in self.bands]
        if least != sorted(least, reverse=True):
            raise ValueError("bands go from the highest minimum down")
        if len({c["id"] for c in self.characteristics}) < len(self.characteristics):
            raise ValueError("characteristic ids repeat")
        for c in self.characteristics:
            for b in c["bins"]:
                parse(b["when"])

    @property
    def version(self) -> str:
        return content_version(self.__dict__, 12)

    def columns(self, schema: T.StructType, today: date) -> dict[str, Column]:
        """score, probability, band, and reasons (code, points_lost), the largest shortfalls first."""
        c = Compiler(schema, today)
        points, lost = [], []
        for ch in self.characteristics:
            value = c.field(ch["field"])
            inner = Compiler(schema, today, {"value": value})
            p = F.lit(0.0)
            for b in reversed(ch["bins"]):
                test = inner.compile(b["when"])
                holds = F.coalesce(test.col, F.lit(False)) if test.kind == "boolean" else F.lit(False)  # true itself, not what counts as true
                p = F.when(holds, F.lit(float(b["points"]))).otherwise(p)
            missing = float(ch.get("missing_points", 0))
            p = F.when(value.col.isNull(), F.lit(missing)).otherwise(p)
            points.append(p)
            most = max([float(b["points"]) for b in ch["bins"]] + [missing])
            lost.append(F.struct((p - most).alias("minus"), F.lit(ch["id"]).alias("code")))
        score = F.round(reduce(lambda a, b: a + b, points), 2)
        factor = self.pdo / log(2)
        offset = self.base_points - factor * log(self.base_odds)
        band = F.lit(self.bands[-1][0]) if self.bands else F.lit(None).cast("string")
        for name, least in reversed(self.bands):
            band = F.when(score >= least, F.lit(name)).otherwise(band)
        ranked = F.slice(F.array_sort(F.filter(F.array(*lost), lambda x: x["minus"] < 0)), 1, self.max_reasons)
        return {
            "score": score,
            "probability": F.round(1 / (1 + F.exp(F.least(F.lit(700.0), (score - offset) / factor))), 6),
            "band": band,
            "reasons": F.transform(ranked, lambda x: F.struct(x["code"].alias("code"), F.round(-x["minus"], 4).alias("points_lost"))),
        }


def score(df: DataFrame, card: Scorecard, today: date) -> DataFrame:
    """``df`` with the scorecard's score, probability, band and reasons."""
    return df.withColumns(card.columns(df.schema, today))


def decide(df: DataFrame, table: DecisionTable, today: date, out: str = "decision") -> DataFrame:
    """``df`` with the table's outputs in ``out``."""
    return df.withColumn(out, table.column(df.schema, today))


def run_strategy(df: DataFrame, strategy: dict[str, Any], today: date) -> DataFrame:
    """Derived facts, then steps; what a step yields is a fact for later ones.

    strategy: facts {name: expression}, steps [{"scorecard": Scorecard} or {"table": DecisionTable}].
    The steps are projections on one row each, which Catalyst folds where it can; nothing is shuffled.
    """
    for name, source in dict(strategy.get("facts") or ()).items():
        df = df.withColumn(name, Compiler(df.schema, today).compile(source).col)
    for step in strategy.get("steps") or []:
        if (card := step.get("scorecard")) is not None:
            cols = card.columns(df.schema, today)
            names = card.outputs or {"score": f"{card.name}_score"}
            df = df.withColumns({fact: cols[k] for k, fact in names.items()})
        elif (table := step.get("table")) is not None:
            df = decide(df, table, today, "__step")
            kind = df.schema["__step"].dataType
            if isinstance(kind, T.StructType):
                df = df.withColumns({f.name if f.name != "_rule" else f"{table.name}_rule": F.col("__step").getField(f.name) for f in kind}).drop("__step")
            else:
                df = df.withColumnRenamed("__step", table.name)
    return df


__all__ = ["DecisionTable", "Scorecard", "Typed", "content_version", "decide", "run_strategy", "score"]
