"""Metadata extraction, scalar text functions and record keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOCAL, _HOST = "[0-9a-zA-Z%+._-]+", "[-.0-9a-zA-Z]+[.][a-zA-Z]{2,}"
EMAIL = rf"\b{_LOCAL}@{_HOST}\b"
DATE = r"\b\d{4}(?:-\d{2}){2}\b"
MONEY = r"[$]\s?[0-9]+(?:,[0-9]{3})*(?:[.][0-9]{2})?\b"
_NAME = "[A-Z][a-z]+"
ENTITY = rf"\b{_NAME}(?:\s+{_NAME})*\b"
#: Tags of documents by words they hold, where a job names none.
DEFAULT_TAGS = {
    "customer": "account client customer profile subscription support".split(),
    "finance": "billing budget invoice payment revenue transaction".split(),
    "security": "access audit breach credential encryption password".split(),
}


def all_matches(text: Column, pattern: str) -> Column:
    """Sorted distinct matches of a pattern; empty for null."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    return F.coalesce(found, F.array().cast("array<string>"))


def tags(text: Column, words: dict[str, list[str]] | None = None) -> Column:
    """Sorted names of the tags of which any word is part of the text, in any case."""
    words = DEFAULT_TAGS if words is None else words
    if not words:
        return F.array().cast("array<string>")

    def found(low: Column) -> Column:
        marks = []
        for tag in sorted(words):
            hit = F.lit(False)
            for w in words[tag]:
                hit = hit | F.contains(low, F.lit(w.lower()))
            marks.append(F.when(hit, F.lit(tag)))
        return F.array_compact(F.array(*marks))

    # the lower-cased text is the variable of a lambda, so that it is made once
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found), F.lit(0))


def classify(tag_list: Column) -> Column:
    """The first of security, finance, customer that is among the tags; else general."""
    out = F.lit("general")
    for name in ("customer", "finance", "security"):
        out = F.when(F.array_contains(tag_list, name), F.lit(name)).otherwise(out)
    return out


def metadata(text: Column, words: dict[str, list[str]] | None = None) -> Column:
    """struct(tags, entities, emails, dates, money, classification)."""
    t = tags(text, words)
    return F.struct(t.alias("tags"), *[all_matches(text, p).alias(n) for n, p in (("entities", ENTITY), ("emails", EMAIL), ("dates", DATE), ("money", MONEY))], classify(t).alias("classification"))


def content_hash(text: Column) -> Column:
    """MD5 of a text's bytes, as hex."""
    return F.md5(text.cast("binary"))


def luhn(number: Column, least: int = 13) -> Column:
    """Whether the digits of a text pass the Luhn check and are ``least`` or more."""
    digits = F.regexp_replace(number, r"\D", "")
    return (F.length(digits) >= least) & F.call_function("luhn_check", digits)


def mask_recipient(address: Column) -> Column:
    """An e-mail address as first letter, stars and host; a number as its first and last two places."""
    user, host = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    n = F.length(address)
    number = F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(address, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(address, F.lit(2))))
    return F.when(F.contains(address, F.lit("@")), F.concat(F.left(user, F.lit(1)), F.lit("***@"), host)).otherwise(number)


def template_fields(template: str) -> list[str]:
    """Names of the fields of a template; anything in braces but a plain name is refused."""
    rest = template.replace("{{", "").replace("}}", "")
    names = re.findall(r"\{([^{}]*)\}", rest)
    if bad := [n for n in names if not re.fullmatch(r"[A-Za-z_]\w*", n)]:
        raise ValueError(f"only plain field names may stand in braces, not {bad}")
    if "{" in re.sub(r"\{[^{}]*\}", "", rest) or "}" in re.sub(r"\{[^{}]*\}", "", rest):
        raise ValueError("a brace stands alone")
    return list(dict.fromkeys(names))


def render(template: str, fields: dict[str, Column], most: int = 4096) -> Column:
    """A template filled in; missing and null fields are empty, and the result is cut at ``most`` characters."""
    template_fields(template)
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            c = fields.get(piece[1:-1])
            parts.append(F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit(""))
        elif piece:
            parts.append(F.lit(piece))
    return F.left(F.concat(*parts), F.lit(most)) if parts else F.lit("")


def idempotency_key(parts: list[Column], most: int = 200) -> Column:
    """Cleaned parts joined by '|'; a long key keeps a readable head and ends in a digest of the whole."""

    def clean(p: Column) -> Column:
        s = F.regexp_replace(F.coalesce(p.cast("string"), F.lit("None")), r"^\s+|\s+$", "")
        s = F.regexp_replace(s, "[^-0-9A-Za-z:_.]+", "-")
        s = F.regexp_replace(s, "^-+|-+$", "")
        return F.when(s == "", F.lit("_")).otherwise(s)

    key = F.concat_ws("|", *map(clean, parts))
    digest = F.left(F.sha2(key.cast("binary"), 256), F.lit(24))
    return F.when(F.length(key) <= most, key).otherwise(F.concat(F.left(key, F.lit(most - 25)), F.lit("#"), digest))


def narrative(columns: list[str], table: str, keys: list[str]) -> Column:
    """[Table: t | PK: k] a: 1 | b: NULL: a row as text; composite keys are joined by '-'."""
    pk = F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    body = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in columns])
    return F.concat(F.lit(f"[Table: {table} | PK: "), pk, F.lit("] "), body)


def record_text(columns: list[str], table: str, key: str) -> Column:
    """The same for change records: null and empty fields are left out."""
    parts = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return F.concat(F.lit(f"[Table: {table} | Record: "), F.col(key).cast("string"), F.lit("] "), F.concat_ws(" | ", *parts))


def clock(seconds: Column, rounded: bool = False) -> Column:
    """MM:SS of a number of seconds, truncated or rounded."""
    s = (F.bround(seconds) if rounded else F.floor(seconds)).cast("long")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
