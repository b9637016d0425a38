"""Change events: normal form, tombstones, key changes, partial updates and current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the formats call an operation.
OPERATIONS = {
    **dict.fromkeys(("c", "create", "insert", "bootstrap-insert", "i"), "INSERT"),
    **dict.fromkeys(("u", "update", "replace", "modify"), "UPDATE"),
    **dict.fromkeys(("d", "delete", "remove"), "DELETE"),
    **dict.fromkeys(("r", "read", "snapshot"), "READ"),
    **dict.fromkeys(("t", "truncate", "drop", "dropdatabase"), "TRUNCATE"),
    **dict.fromkeys(("heartbeat", "m"), "HEARTBEAT"),
}
DATA_CHANGES = tuple("DELETE INSERT READ UPDATE".split())


def operation(c: Column) -> Column:
    """A format's own word as one of the normal operations, else UNKNOWN."""
    pairs = F.create_map(*[x for k, v in OPERATIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.coalesce(c, F.lit("")))), F.lit("UNKNOWN"))


def is_data_change(c: Column) -> Column:
    return c.isin(*DATA_CHANGES)


_ENVELOPE = "op after before source ts_ms".split()
_FIELDS = _ENVELOPE + "payload operationType type data database fullDocument updateDescription clusterTime ts ns table documentKey primary_key key operation action record timestamp_ms".split()


def _parsed(c: Column, names: list[str]) -> Column:
    """The fields of a JSON object as texts, all read in one parse."""
    return F.from_json(c, ", ".join(f"`{n}` string" for n in names))


def _in(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def normalise(events: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON change events as (format, operation, database, table, key, record, removed, partial, ts_ms).

    Looks for a document store's operationType, then for type with data and database, then for op with
    before, after or source (in an envelope or not), else reads generic fields. Texts that are no JSON
    are UNKNOWN. An event is parsed once, its parts where they are needed; no shuffle.
    """
    df = events.withColumn("__a", _parsed(F.col(payload), _FIELDS))
    df = df.withColumn("__r", F.when(F.col("__a.payload").isNotNull(), _parsed(F.col("__a.payload"), _ENVELOPE)).otherwise(F.struct(*[F.col(f"__a.{n}").alias(n) for n in _ENVELOPE])))
    a, r = (lambda n: F.col(f"__a.{n}")), (lambda n: F.col(f"__r.{n}"))
    stream = a("operationType").isNotNull()
    typed = a("type").isNotNull() & a("data").isNotNull() & a("database").isNotNull()
    enveloped = r("op").isNotNull() & (r("after").isNotNull() | r("before").isNotNull() | r("source").isNotNull())
    df = df.withColumn("format", F.when(stream, "document").when(typed, "binlog").when(enveloped, "envelope").otherwise("generic"))

    def pick(document: Column, binlog: Column, envelope: Column, generic: Column) -> Column:
        f = F.col("format")
        return F.when(f == "document", document).when(f == "binlog", binlog).when(f == "envelope", envelope).otherwise(generic)

    none = F.lit(None).cast("string")
    word = pick(a("operationType"), a("type"), r("op"), F.coalesce(a("operation"), a("op"), a("type"), a("action")))
    df = df.withColumn("operation", operation(word))
    image = F.when(F.col("operation") == "DELETE", r("before")).otherwise(r("after"))
    millis = pick(a("clusterTime"), (a("ts").try_cast("long") * 1000).cast("string"), F.coalesce(r("ts_ms"), _in(r("source"), "ts_ms")), F.coalesce(a("timestamp_ms"), a("ts_ms")))
    return df.select(
        *events.columns,
        "format",
        "operation",
        pick(_in(a("ns"), "db"), a("database"), _in(r("source"), "db"), a("database")).alias("database"),
        pick(_in(a("ns"), "coll"), a("table"), F.coalesce(_in(r("source"), "table"), _in(r("source"), "collection")), a("table")).alias("table"),
        pick(
            _in(a("documentKey"), "_id"),
            F.coalesce(_in(a("primary_key"), "id"), _in(a("data"), "id")),
            F.coalesce(_in(r("after"), "id"), _in(r("before"), "id")),
            F.coalesce(a("key"), _in(a("record"), "id"), _in(a("data"), "id")),
        ).alias("key"),
        pick(F.coalesce(a("fullDocument"), _in(a("updateDescription"), "updatedFields")), a("data"), image, F.coalesce(a("record"), a("data"), a("after"))).alias("record"),
        F.from_json(pick(_in(a("updateDescription"), "removedFields"), none, none, none), "array<string>").alias("removed"),
        ((F.col("format") == "document") & a("updateDescription").isNotNull() & a("fullDocument").isNull()).alias("partial"),
        millis.try_cast("long").alias("ts_ms"),
    )


def tombstones(records: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Records with an operation: a key without a value deletes it; a value without a key is kept as it is."""
    return records.withColumn("operation", F.when(F.col(value).isNull() & F.col(key).isNotNull(), "DELETE").when(F.col(value).isNull(), "UNKNOWN").otherwise("UPDATE"))


def split_key_changes(changes: DataFrame, old_key: str, new_key: str, operation_col: str = "operation") -> DataFrame:
    """An update that changes its key as a delete of the old and an insert of the new one."""
    moved = (F.col(operation_col) == "UPDATE") & F.col(old_key).isNotNull() & ~F.col(old_key).eqNullSafe(F.col(new_key))
    one = lambda k, op, part: F.struct(F.col(k).alias("key"), op.alias("op"), F.lit(part).alias("part"))
    rows = F.when(moved, F.array(one(old_key, F.lit("DELETE"), 0), one(new_key, F.lit("INSERT"), 1))).otherwise(F.array(one(new_key, F.col(operation_col), 0)))
    return changes.withColumn("__e", F.explode(rows)).withColumn(operation_col, F.col("__e.op")).withColumn("key", F.col("__e.key")).withColumn("part", F.col("__e.part")).drop("__e")


def merge_partial(old: Column, new: Column) -> Column:
    """A map with the fields that changed laid over what was known."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, none), F.coalesce(new, none), lambda k, a, b: F.coalesce(b, a))


def latest_state(changes: DataFrame, key: str, order: list[str], operation_col: str = "operation") -> DataFrame:
    """The last change of each key in order, without keys that it deletes.

    The greatest order struct carries its row along through a partial aggregate, so a hot key sends
    one row a task and is never sorted.
    """
    place = F.struct(*[F.col(c) for c in order])
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("r"))
    return last.select(key, "r.*").filter(F.col(operation_col) != "DELETE")


def first_wins(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The first change of each key only, as the batch runner keeps it; see latest_state for the rest."""
    from orbweaver.operators.records import keep_first

    return keep_first(changes, key, order)


def lsn_to_int(c: Column) -> Column:
    """A log position 'X/Y' (hexadecimal) as a number."""
    high, low = F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))
    return F.conv(high, 16, 10).cast("long") * (1 << 32) + F.conv(low, 16, 10).cast("long")


def lsn_to_text(c: Column) -> Column:
    return F.concat(F.hex(F.shiftright(c, 32)), F.lit("/"), F.hex(c.bitwiseAND((1 << 32) - 1)))


def explode_payloads(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Batches as single events: an array, {"events": [...]}, lines of JSON, or one event."""
    c = F.trim(F.col(col))
    wrapped = F.get_json_object(c, "$.events")
    listed = F.when(c.startswith("["), c).when(wrapped.startswith("["), wrapped)
    items = F.when(listed.isNotNull(), F.from_json(listed, "array<string>")).otherwise(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))
    whole = listed.isNull() & F.get_json_object(c, "$").isNotNull() & ~F.contains(c, F.lit("}\n{"))
    return payloads.withColumn(col, F.explode(F.when(whole, F.array(c)).otherwise(items)))




def after_truncates(changes: DataFrame, order: str, table: str | None = None, operation_col: str = "operation") -> DataFrame:
    """The changes that no later truncate of their table undoes, without the truncates themselves.

    A table's last truncate is one row, joined to its changes by the table.
    """
    by = F.col(table) if table else F.lit("")
    rows = changes.withColumn("__table", by)
    cuts = rows.filter(F.col(operation_col) == "TRUNCATE").groupBy("__table").agg(F.max(order).alias("__cut"))
    rest = rows.filter(F.col(operation_col) != "TRUNCATE").join(cuts, "__table", "left")
    return rest.filter(F.col("__cut").isNull() | (F.col(order) > F.col("__cut"))).select(*changes.columns)


#: Names of a key where a record names none, in order.
KEY_NAMES = ("id", "_id", "uuid", "pk", "key")


def record_key(columns: list[str], explicit: list[str] | None = None) -> Column:
    """The key of a record: its explicit parts joined by '|', else the first usual name, else a digest of the record.

    The digest is ``h:`` and 24 hexadecimal digits of SHA-256 over the record as JSON, fields by name.
    """
    said = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in KEY_NAMES if c in columns]
    digest = F.concat(F.lit("h:"), F.left(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256), F.lit(24)))
    parts = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in sorted(explicit)]) if explicit else None
    return F.coalesce(*([parts] if parts is not None else []), *said, digest)


#: Subtypes of chat messages that say nothing.
NOISE = tuple(sorted({*(f"channel_{x}" for x in "archive join leave name purpose topic unarchive".split()), "group_join", "group_leave", "bot_add", "bot_remove", "pinned_item", "reminder_add"}))


def chat_events(events: DataFrame, col: str = "event") -> DataFrame:
    """``events`` (JSON of message events) with action (upsert, delete, ignore), message and deleted_ts.

    An edited message is upserted in its new form, so that it replaces the stored one by its ts.
    """
    e = F.col("__e")
    df = events.withColumn("__e", _parsed(F.col(col), "type subtype deleted_ts previous_message message text files ts".split()))
    new_ts = F.nullif(F.get_json_object(e["message"], "$.ts"), F.lit(""))
    gone = F.coalesce(F.nullif(e["deleted_ts"], F.lit("")), F.get_json_object(e["previous_message"], "$.ts"))
    empty = F.coalesce(F.nullif(e["text"], F.lit("")), F.nullif(e["files"], F.lit("[]"))).isNull()
    action = (
        F.when(e["type"].isNull() | (e["type"] != "message"), "ignore")
        .when(e["subtype"] == "message_deleted", "delete")
        .when(e["subtype"] == "message_changed", F.when(new_ts.isNotNull(), "upsert").otherwise("ignore"))
        .when(F.coalesce(e["subtype"].isin(*NOISE), F.lit(False)) | empty, "ignore")
        .otherwise("upsert")
    )
    df = df.withColumn("action", action)
    message = F.when(F.col("action") == "upsert", F.when(e["subtype"] == "message_changed", e["message"]).otherwise(F.col(col)))
    return df.withColumn("message", message).withColumn("deleted_ts", F.when(F.col("action") == "delete", gone)).drop("__e")
