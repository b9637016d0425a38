"""A PostgreSQL server as a source: what it needs, its slot, snapshots of tables and the stream of transactions.

All calls go through ``query``, a function of SQL and parameters that returns rows, and a connection's own
message iterator, so that any driver fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.operators.cdc import lsn_to_int
from orbweaver.sources.pgoutput import Decoder, Transaction

Query = Callable[..., list[tuple]]


def prerequisite_problems(query: Query, publication: str) -> list[str]:
    """What stands in the way of streaming, each with the remedy."""
    out = []
    level = query("SHOW wal_level")[0][0]
    if level != "logical":
        out.append(f"wal_level is {level}: set it to logical and restart the server")
    if not query("SELECT bool_or(rolreplication OR rolsuper) FROM pg_roles WHERE rolname = current_user")[0][0]:
        out.append("the role may not replicate: ALTER ROLE ... REPLICATION")
    if not query("SELECT count(*) FROM pg_publication WHERE pubname = %s", publication)[0][0]:
        out.append(f"there is no publication {publication}: CREATE PUBLICATION {publication} FOR TABLE ...")
        return out
    bare = query(
        "SELECT t.schemaname, t.tablename FROM pg_publication_tables t JOIN pg_class c ON c.oid = format('%%I.%%I', t.schemaname, t.tablename)::regclass"
        " WHERE t.pubname = %s AND (c.relreplident = 'n' OR c.relreplident = 'd' AND NOT EXISTS (SELECT FROM pg_index i WHERE i.indrelid = c.oid AND i.indisprimary)) ORDER BY 1, 2",
        publication,
    )
    if bare:
        out.append(f"no replica identity: {', '.join('.'.join(r) for r in bare)}: add a primary key, or ALTER TABLE ... REPLICA IDENTITY FULL")
    return out


def slot_states(slots: DataFrame, current_lsn: Column | str) -> DataFrame:
    """Slots (slot_name, active, confirmed_flush_lsn, wal_status, invalidation_reason, conflicting) with lag_bytes and state.

    A lost slot can't deliver every change any more, so its tables have to be read anew.
    """
    now = lsn_to_int(current_lsn if isinstance(current_lsn, Column) else F.lit(current_lsn))
    lost = F.coalesce(F.col("wal_status") == "lost", F.lit(False)) | (F.coalesce(F.col("invalidation_reason"), F.lit("")) != "") | F.coalesce(F.col("conflicting"), F.lit(False))
    state = F.when(lost, "lost").when(F.col("active"), "active").otherwise("idle")
    return slots.withColumn("lag_bytes", now - lsn_to_int(F.col("confirmed_flush_lsn"))).withColumn("state", state)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def snapshot_sql(schema: str, table: str, columns: list[str] | None = None, row_filter: str | None = None, limit: int | None = None) -> str:
    """The statement of a table's snapshot: the publication's columns, its row filter and a limit are the server's work."""
    what = ", ".join(map(quoted, columns)) if columns else "*"
    out = f"SELECT {what} FROM {quoted(schema)}.{quoted(table)}"
    return out + (f" WHERE {row_filter}" if row_filter else "") + (f" LIMIT {int(limit)}" if limit is not None else "")


def snapshot(spark: SparkSession, url: str, statement: str, properties: dict[str, str], batch: int = 500) -> DataFrame:
    """A snapshot through JDBC, ``batch`` rows a fetch. Needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=statement, fetchsize=str(batch), **properties).load()


@dataclass
class TransactionStream:
    """Transactions of a logical stream in order, and what has been confirmed.

    ``messages`` yields (position after the message, payload), or None while the server is idle; ``send`` tells
    the server a position. A transaction counts as received only once it is confirmed, after it was applied.
    """

    messages: Iterable[tuple[int, bytes] | None]
    send: Callable[[int], None]
    confirmed: int = 0
    decoder: Decoder = field(default_factory=Decoder)
    waiting: list[int] = field(default_factory=list)

    def transactions(self) -> Iterator[tuple[int, Transaction] | None]:
        """(position, transaction) of each commit; None when there is nothing now, so that the caller can do other work."""
        for m in self.messages:
            if m is None:
                yield None
            elif (done := self.decoder.feed(m[1])) is not None:
                self.waiting.append(m[0])
                yield m[0], done

    def confirm(self, position: int) -> None:
        """Everything up to ``position`` is applied durably; earlier positions are no news."""
        if position not in self.waiting and position > self.confirmed:
            raise ValueError(f"{position} ends no transaction that was delivered")
        if position > self.confirmed:
            self.confirmed = position
            self.waiting = [p for p in self.waiting if p > position]
            self.send(position)

    def keepalive(self) -> None:
        """Tell the server that the client is there, without confirming anything new."""
        self.send(self.confirmed)


def transaction_rows(position: int, t: Transaction) -> list[tuple]:
    """(position, place, operation, schema, table, key, record) of a transaction's events, for a table of changes."""
    return [(position, i, e["operation"], e["schema"], e["table"], e["key"], e["record"]) for i, e in enumerate(t.events)]
