"""Validation, first-wins dedupe, event times and record transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHONE = r"[+]?[0-9][-.()\s0-9]{7,}[0-9]"
EDGE_SPACE = r"^\s+|\s+$"


def missing_reason(required: list[str], columns: list[str]) -> Column:
    """'missing required fields: a, b' in the configured order; null where none is missing."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull() if c in columns else F.lit(True), F.lit(c)) for c in required]))
    return F.when(F.size(names) > 0, F.concat(F.lit("missing required fields: "), F.array_join(names, ", ")))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in input order; null keys are one key.

    Only (order) minima travel: keys aggregate before the shuffle and the rows are filtered by a join
    with them, so a hot key is not sorted by one task.
    """
    first = df.groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__o"))
    return df.join(first, df[key].eqNullSafe(F.col("__k")) & (df[order] == F.col("__o")), "left_semi")


def validate(df: DataFrame, required: list[str], key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, first of each key; invalid rows with their reason). Later duplicates are dropped."""
    tagged = df.withColumn("error", missing_reason(required, df.columns))
    return keep_first(tagged.filter("error IS NULL").drop("error"), key, order), tagged.filter("error IS NOT NULL")


def event_time(value: Column, kind: str = "string") -> Column:
    """A timestamp of ISO text, or of a number: milliseconds if over ten thousand million, else seconds."""
    if kind == "string":
        return F.try_to_timestamp(value)
    n = value.cast("double")
    return F.timestamp_micros(F.when(n > 1e10, n * 1e3).otherwise(n * 1e6).cast("long"))


def high_water_mark(df: DataFrame, time_col: str) -> DataFrame:
    """One row: the latest event time as ISO text."""
    return df.agg(F.date_format(F.max(time_col), "yyyy-MM-dd'T'HH:mm:ss").alias("high_water_mark"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, also after digits and marks."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def redact(c: Column) -> Column:
    """E-mail addresses, then phone numbers."""
    from orbweaver.operators.enrich import EMAIL

    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[REDACTED_EMAIL]"), PHONE, "[REDACTED_PHONE]")


def transform(df: DataFrame, trim: bool = True, rename: dict[str, str] | None = None, defaults: dict[str, object] | None = None, case: dict[str, str] | None = None, redact_pii: bool = False) -> DataFrame:
    """Trim, rename, default, change case and redact, in this order.

    A default fills a column that is absent, not one that is null. All steps are one projection.
    """
    text = lambda d: [c for c, t in d.dtypes if t == "string"]
    if trim:
        df = df.withColumns({c: strip(F.col(c)) for c in text(df)})
    df = df.withColumnsRenamed(rename or {})
    df = df.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in df.columns})
    for c, how in (case or {}).items():
        if how not in ("lower", "upper", "title"):
            raise ValueError(f"case is lower, upper or title, not {how}")
        if c in df.columns:
            df = df.withColumn(c, {"lower": F.lower, "upper": F.upper, "title": title_case}[how](F.col(c)))
    if redact_pii:
        df = df.withColumns({c: redact(F.col(c)) for c in text(df)})
    return df


def joined_text(columns: list[str]) -> Column:
    """Non-null fields joined by a space."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def non_empty_text(columns: list[str]) -> Column:
    """Fields that are not empty, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def path(document: Column, dotted: str) -> Column:
    """A value of a JSON text by a dotted path, as text; null if any part is missing."""
    return F.get_json_object(document, "$." + dotted)


def last_n(df: DataFrame, key: str, order: str, n: int = 8) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
