"""Queries of windows, trends, change events and reply intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators import cdc, intents, timeseries
from orbweaver.session import load


def window_stats_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timeseries.window_stats(load(spark, sf_dir, "events"), ["event_type"], "ts", "value", "event_id")
    return got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def slope_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.slopes(load(spark, sf_dir, "events"), ["event_type"], "ts", "value")


def trailing_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the 24 hours up to each event (a range frame in seconds)."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86_400, 0)
    return e.select("event_id", F.count("*").over(w).alias("n_day"))


def diagnose_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = [
        {"name": "buyer", "requires": ["purchase", "view"], "supports": ["click"]},
        {"name": "browser", "requires": ["view"], "supports": ["click", "signup"]},
        {"name": "broken", "requires": ["error", "error2"], "sensor": True},
    ]
    e = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("asset")).agg(F.collect_set("event_type").alias("symptoms"))  # five kinds at most
    return timeseries.diagnose(e, faults)


SIGNALS = {k: timeseries.Signal(k, warn_high=90.0, alarm_high=98.0, valid_max=1e6) for k in ("click", "view", "purchase", "signup", "error")}


def asset_monitor_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as an asset, each kind of event as a metric."""
    e = load(spark, sf_dir, "events")
    return timeseries.assess_batch(e, SIGNALS, "user_id", "event_type", "ts", "value", "event_id")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    row = F.to_json(F.struct(F.col("user_id").alias("id"), "value", F.col("event_id").alias("version")))
    body = F.concat(F.lit('{"op":"'), op, F.lit('","'), F.when(op == "d", "before").otherwise("after"), F.lit('":'), row, F.lit(',"source":{"table":"users","db":"shop"},"ts_ms":'), F.col("event_id").cast("string"), F.lit("}"))
    return cdc.normalise(e.select("event_id", F.when(F.col("event_id") % 2 == 0, body).otherwise(F.concat(F.lit('{"payload":'), body, F.lit("}"))).alias("payload")))


def cdc_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("event_id", "format", "operation", "database", "table", "key", "ts_ms", F.get_json_object("record", "$.version").cast("long").alias("version"))


def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = cdc.latest_state(_changes(spark, sf_dir), "key", ["ts_ms", "event_id"])
    return last.select("key", "operation", F.get_json_object("record", "$.version").cast("long").alias("version"))


def cdc_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.first_wins(_changes(spark, sf_dir), "key", "event_id").select("event_id", "key", "operation")


def cdc_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer differs from that of the order before, as key changes."""
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders").withColumn("old_key", F.lag("o_custkey").over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey"))).withColumn("operation", F.lit("UPDATE"))
    return cdc.split_key_changes(o, "old_key", "o_custkey").select("o_orderkey", "operation", "key", "part")


def lsn_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * 7_919_000_003
    return load(spark, sf_dir, "orders").select("o_orderkey", cdc.lsn_to_text(n).alias("lsn"), cdc.lsn_to_int(cdc.lsn_to_text(n)).alias("number"))


def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = intents.classify(load(spark, sf_dir, "conversations"), lexicon={"ask": [(r"\bthe\b", 0.6), (r"ing\b", 0.5)], "tell": [(r"\band\b", 0.7)], "stop_contact": [(r"\bof\b", 0.55)]})
    return got.select("conv_id", "turn", "intent", "confidence", "needs_review")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").join(lab, "doc_id", "left").select("doc_id", "text", F.coalesce("toxic", F.col("doc_id") % 2).cast("int").alias("label"))


def nb_fit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts of word features (the character features have no SQL)."""
    c = intents.nb_counts(_labelled(spark, sf_dir)).filter(F.col("feature").startswith("w:"))
    return c.select("label", "feature", "n", "df")


def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir)
    return intents.nb_predict(d, d, "doc_id")


def fold_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", intents.fold(F.col("text"), 5).alias("fold"))


QUERIES = {
    f.__name__: f
    for f in (
        window_stats_10m, slope_by_type, trailing_contacts, diagnose_users, asset_monitor_assess, cdc_normalised, cdc_latest_state, cdc_first_wins, cdc_key_changes, lsn_round_trip,
        intent_scores, nb_fit_counts, nb_predict, fold_of_text,
    )
}

_OPS = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"
ORACLES = {
    "window_stats_10m": """SELECT event_type, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, count(value) AS n, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, arg_max(value, event_id) AS last FROM events GROUP BY 1, 2""",
    "slope_by_type": """WITH d AS (SELECT event_type, epoch_us(ts) / 3.6e9 AS x, value AS y FROM events WHERE value IS NOT NULL),
g AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d GROUP BY 1)
SELECT event_type, n, CASE WHEN n >= 10 AND sxx > 0 THEN round(b, 6) END AS slope_per_hour, CASE WHEN n >= 10 AND sxx > 0 THEN abs(b) / sqrt(greatest(0, syy - b * sxy) / (n - 2) / sxx) >= 4 END AS significant FROM g""",
    "trailing_contacts": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_day FROM events",
    "diagnose_users": """WITH s AS (SELECT user_id AS asset, list(DISTINCT event_type) AS k FROM events GROUP BY 1)
SELECT asset, CASE WHEN list_has_all(k, ['purchase', 'view']) THEN 'buyer' WHEN list_contains(k, 'view') THEN 'browser' END AS fault,
 round(CASE WHEN list_has_all(k, ['purchase', 'view']) THEN least(0.95, 0.55 + 0.3 * list_contains(k, 'click')::INT + 0.1) WHEN list_contains(k, 'view') THEN least(0.95, 0.55 + 0.3 * ((list_contains(k, 'click')::INT + list_contains(k, 'signup')::INT) / 2.0)) END, 4)::DOUBLE AS confidence FROM s""",
    "cdc_normalised": f"SELECT event_id, 'envelope' AS format, {_OPS} AS operation, 'shop' AS database, 'users' AS \"table\", user_id::VARCHAR AS key, event_id AS ts_ms, event_id AS version FROM events",
    "cdc_latest_state": f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id::VARCHAR AS key, {_OPS} AS operation, event_id AS version FROM l WHERE r = 1 AND event_type <> 'error'",
    "cdc_first_wins": f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT event_id, user_id::VARCHAR AS key, {_OPS} AS operation FROM l WHERE r = 1",
    "cdc_key_changes": """WITH o AS (SELECT o_orderkey, o_custkey AS k, lag(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM orders)
SELECT o_orderkey, CASE WHEN p IS NOT NULL AND p <> k THEN 'INSERT' ELSE 'UPDATE' END AS operation, k AS key, CASE WHEN p IS NOT NULL AND p <> k THEN 1 ELSE 0 END AS part FROM o
UNION ALL SELECT o_orderkey, 'DELETE', p, 0 FROM o WHERE p IS NOT NULL AND p <> k""",
    "lsn_round_trip": "SELECT o_orderkey, printf('%X/%X', (o_orderkey * 7919000003) >> 32, (o_orderkey * 7919000003) & 4294967295) AS lsn, o_orderkey * 7919000003 AS number FROM orders",
    "intent_scores": r"""WITH s AS (SELECT conv_id, turn, round(1 - (CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN 1 - 0.6 ELSE 1.0 END) * (CASE WHEN regexp_matches(text, '(?i)ing\b') THEN 0.5 ELSE 1.0 END), 4)::DOUBLE AS a,
 CASE WHEN regexp_matches(text, '(?i)\band\b') THEN 0.7 ELSE 0.0 END::DOUBLE AS t, CASE WHEN regexp_matches(text, '(?i)\bof\b') THEN 0.55 ELSE 0.0 END::DOUBLE AS g FROM conversations),
c AS (SELECT *, CASE WHEN a >= t AND a >= 0.5 THEN 'ask' WHEN t >= 0.5 THEN 'tell' WHEN g >= 0.5 THEN 'stop_contact' ELSE 'other' END AS intent FROM s),
f AS (SELECT conv_id, turn, intent, round(CASE intent WHEN 'ask' THEN a - 0.5 * t WHEN 'tell' THEN t - 0.5 * a WHEN 'stop_contact' THEN greatest(0, g - 0.5 * greatest(a, t)) ELSE 0 END, 4) AS confidence FROM c)
SELECT *, confidence < 0.6 AS needs_review FROM f""",
    "nb_fit_counts": r"""WITH d AS (SELECT item_id, text, coalesce(l.toxic, item_id % 2)::INT AS label FROM benchmark LEFT JOIN labels l ON l.doc_id = item_id),
w AS (SELECT item_id, label, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM d),
f AS (SELECT item_id, label, 'w:' || CASE WHEN regexp_full_match(w, '\d+') THEN repeat('#', least(6, length(w))) ELSE w END AS feature FROM w)
SELECT label, feature, count(*) AS n, count(DISTINCT item_id) AS df FROM f GROUP BY 1, 2""",
    "fold_of_text": """WITH h AS (SELECT item_id, sha256(text) AS h FROM benchmark), b AS (SELECT item_id, list_transform(range(1, 64, 2), lambda i: ('0x' || substr(h, i, 2))::INT) AS b FROM h)
SELECT item_id, (list_sum(b) % 5)::INT AS fold FROM b""",
}
