"""Streams out of and into the engine: results pulled row by row, and tables fed by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from tessera.client import Session
from tessera.sql.errors import SqlError


def pull(session: Session, sql: str, params: dict | None = None, level: str = "snapshot") -> Iterator[Row]:
    """Rows of a query one by one, a partition at a time on the driver, in a transaction of their own.

    The transaction commits when the last row is taken and rolls back if the reader stops earlier or fails.
    """
    tx = session.db.begin(level) if session.db is not None else None
    done = False
    try:
        result = session.execute(sql, params, tx)
        if result.df is None:
            raise SqlError("Only queries have rows to pull")
        yield from result
        done = True
    finally:
        if tx is not None:
            tx.commit() if done else tx.rollback()


def feed(session: Session, table: str, stream: DataFrame, checkpoint: str, **trigger):
    """A streaming query that inserts each micro-batch into a table, in one transaction per batch.

    The commit of a batch names the stream (by its checkpoint) and the batch's number. A batch that was committed before a
    failure comes again with the same number, and is skipped; so a restart from the checkpoint inserts every row once.
    """
    stream_name = f"{table}@{checkpoint}"

    def insert(batch: DataFrame, batch_id: int) -> None:
        tx = session.db.begin()
        if tx.base.get("streams", {}).get(stream_name, -1) >= batch_id:
            return tx.rollback()
        tx.batch = (stream_name, batch_id)
        tx.insert(table, batch.select(*[c["name"] for c in tx.table(table).columns]))
        tx.commit()

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
