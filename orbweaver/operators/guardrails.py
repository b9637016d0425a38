"""Guardrails: personal data, prompt screening, policies and grounding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweaver.operators.enrich import EMAIL, luhn
from orbweaver.operators.ranking import overlap

_B64 = "[A-Za-z0-9_-]"
_BYTE = "(?:1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])"
_GAP = r"[-.\s]?"
_KEYS = (
    rf"sk-(?:ant-|proj-)?{_B64}{{16,}}",
    r"AKIA[A-Z0-9]{16}",
    rf"AIza{_B64}{{35}}",
    r"gh[oprsu]_[0-9A-Za-z]{36}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}",
    r"sk_(?:test|live)_[0-9A-Za-z]{16,}",
)
#: Secrets first, as they may hold digits that looser patterns would split.
PATTERNS = {
    "jwt": r"\beyJ" + r"\.".join([_B64 + "{5,}"] * 3),
    "api_key": r"\b(?:" + "|".join(_KEYS) + ")",
    "email": EMAIL,
    "ssn": r"\b\d{3}-\d\d-\d{4}\b",
    "credit_card": r"\b(?:[0-9][- ]?){13,19}\b",
    "phone": r"(?<![+\w])[+][0-9]{1,3}" + _GAP + r"\d{2,5}" + (_GAP + r"\d{3,5}") * 2 + r"\b|\b(?:\+?1" + _GAP + r")?\(?\d{3}\)?" + _GAP + r"\d{3}" + _GAP + r"\d{4}\b",
    "ip_address": rf"\b(?:{_BYTE}\.){{3}}{_BYTE}\b",
}
MASKS = {k: f"[{v}]" for k, v in {"jwt": "JWT_TOKEN", "api_key": "API_KEY", "email": "EMAIL", "ssn": "SSN", "credit_card": "CREDIT_CARD", "phone": "PHONE", "ip_address": "IP_ADDRESS"}.items()}
TOKEN = "[A-Za-z0-9_]+"


def normalise_text(text: str) -> str:
    """Compatibility forms folded, and characters that show nothing dropped."""
    return "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")


@F.pandas_udf(T.StringType())
def _normalise(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else normalise_text(t))


def normalised(text: Column) -> Column:
    """Normalised text. There is no built-in for it, so it is an Arrow function; ASCII texts pass unchanged."""
    return _normalise(text)


def detections(text: Column, detectors: list[str] | None = None) -> Column:
    """Names of the detectors that find something, in the given order; on normalised text, no Python."""
    found = []
    for d in detectors or list(PATTERNS):
        if d == "credit_card":
            hit = F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[d]), F.lit(0)), lambda x: luhn(x, 13))
        else:
            hit = F.rlike(text, F.lit(PATTERNS[d]))
        found.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(d)))
    return F.array_compact(F.array(*found))


def detection_counts(text: Column, detectors: list[str]) -> dict[str, Column]:
    """How often each pattern matches."""
    return {f"n_{d}": F.coalesce(F.size(F.regexp_extract_all(text, F.lit(PATTERNS[d]), F.lit(0))), F.lit(0)) for d in detectors}


def _passes_luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return len(digits) >= 13 and total % 10 == 0


def mask_text(text: str | None, detectors: list[str] | None = None) -> str | None:
    """Normalised text with every finding masked, secrets first; card numbers only if they pass the check."""
    if text is None:
        return None
    out = text if text.isascii() else normalise_text(text)
    for d in PATTERNS:
        if detectors is None or d in detectors:
            if d == "credit_card":
                out = re.sub(PATTERNS[d], lambda m: MASKS["credit_card"] if _passes_luhn(m[0]) else m[0], out)
            else:
                out = re.sub(PATTERNS[d], MASKS[d], out)
    return out


def mask(text: Column, detectors: list[str] | None = None) -> Column:
    """mask_text as an Arrow function: a card is replaced on a condition, which regexp_replace can't state."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask_text(t, detectors))

    return run(text)


def contains_any(text: Column, terms: list[str]) -> Column:
    """The terms that are part of the lower-cased text, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)) if terms else F.array().cast("array<string>")


def inspect_prompt(text: Column, blocked: list[str], leakage: list[str]) -> Column:
    """Findings of blocked patterns, then of leakage terms."""
    a = F.transform(contains_any(text, blocked), lambda t: F.concat(F.lit("blocked pattern: "), t))
    return F.concat(a, F.transform(contains_any(text, leakage), lambda t: F.concat(F.lit("leakage term: "), t)))


def policy_findings(text: Column, policies: list[dict]) -> Column:
    """(policy, term, severity) of every blocked term of the input policies; severity is the policy's action."""
    rows = [F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t.lower())), F.struct(F.lit(p["name"]).alias("policy"), F.lit(t).alias("term"), F.lit(p.get("action", "block")).alias("severity"))) for p in policies for t in p.get("terms", [])]
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<policy:string,term:string,severity:string>>")


def token_set(text: Column) -> Column:
    """Distinct lower-cased tokens; no hyphens, unlike the retrieval tokens."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower))


def off_topic(text: Column, keywords: list[str], least: float) -> Column:
    """Whether too few of the keywords are among the text's tokens; never without keywords."""
    if not keywords:
        return F.lit(False)
    known = F.array(*[F.lit(k.lower()) for k in keywords])
    return overlap(token_set(text), known) < least


def grounding(answer: Column, contexts: Column, least: float = 0.5) -> dict[str, Column]:
    """confidence (share of the answer's tokens that its contexts hold) and blocked; no context always blocks."""
    a = token_set(answer)
    c = F.array_distinct(F.flatten(F.transform(F.coalesce(contexts, F.array().cast("array<string>")), token_set)))
    none = F.size(F.coalesce(contexts, F.array().cast("array<string>"))) == 0
    share = F.when(none | (F.size(a) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))
    return {"confidence": F.round(share, 4), "blocked": none | (share < least)}


def compose_answer(contexts: Column, prefix: str = "Based on the retrieved context: ") -> Column:
    return F.concat(F.lit(prefix), F.array_join(contexts, " "))


def evaluate(queries: DataFrame, contexts: DataFrame, blocked: list[str], leakage: list[str], policies: list[dict], keywords: list[str], least_overlap: float = 0.0, least_grounding: float = 0.2, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Questions with decision, findings, answer and confidence.

    ``contexts`` is (id, contexts array). Stages are columns of one plan; a question that the first
    screening blocks gets no answer.
    """
    q = queries.withColumn("clean", normalised(F.col(text_col)))
    q = q.withColumn("pii", detections(F.col("clean"))).withColumn("findings", F.concat(inspect_prompt(F.col("clean"), blocked, leakage), F.transform(policy_findings(F.col("clean"), policies), lambda x: F.concat(F.lit("policy "), x["policy"], F.lit(": "), x["term"]))))
    q = q.withColumn("stop", (F.size("findings") > 0) | off_topic(F.col("clean"), keywords, least_overlap)).withColumn("masked", mask(F.col("clean")))
    j = q.join(contexts, id_col, "left").withColumn("contexts", F.when(F.col("stop"), F.array().cast("array<string>")).otherwise(F.coalesce("contexts", F.array().cast("array<string>"))))
    j = j.withColumn("answer", mask(compose_answer(F.col("contexts"))))
    g = grounding(F.col("answer"), F.col("contexts"), least_grounding)
    j = j.withColumn("confidence", g["confidence"]).withColumn("ungrounded", g["blocked"])
    screened = F.size(inspect_prompt(F.col("answer"), blocked, [])) > 0
    decision = F.when(F.col("stop"), "block").when(F.col("ungrounded") | screened, "block").when(F.size("pii") > 0, "warn").otherwise("allow")
    return j.select(id_col, "masked", "pii", "findings", decision.alias("decision"), F.when(decision != "block", F.col("answer")).alias("answer"), "confidence")


_US_PHONE = r"\b(?:\+?1" + _GAP + r")?\(?\d{3}\)?" + _GAP + r"\d{3}" + _GAP + r"\d{4}\b"


def raw_pii(text: Column) -> Column:
    """Whether a text shows an e-mail address, a social security or telephone number, or a card that passes its check."""
    t = F.coalesce(text, F.lit(""))
    cards = F.regexp_extract_all(t, F.lit(PATTERNS["credit_card"]), F.lit(0))
    return t.rlike(PATTERNS["email"]) | t.rlike(PATTERNS["ssn"]) | t.rlike(_US_PHONE) | F.exists(cards, lambda c: luhn(c))


def output_findings(answer: Column, n_citations: Column, masked: Column, policies: list[dict]) -> Column:
    """(policy, needs, severity) of the output policies that an answer breaks: citations, or masking where raw data shows."""
    rows = []
    for p in policies:
        one = lambda needs, p=p: F.struct(F.lit(p["name"]).alias("policy"), F.lit(needs).alias("needs"), F.lit(p.get("action", "block")).alias("severity"))
        if p.get("require_citations"):
            rows.append(F.when(F.coalesce(n_citations, F.lit(0)) == 0, one("citations")))
        if p.get("require_masking"):
            rows.append(F.when(~F.coalesce(masked, F.lit(False)) & raw_pii(answer), one("masking")))
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<struct<policy:string,needs:string,severity:string>>")
