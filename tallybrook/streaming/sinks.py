"""Sinks of batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybrook.sources.database import FLAGGED, PROCESSED, BatchLog, Database
from tallybrook.sources.transactions import to_messages


def _once_read(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Keeps a batch while several tables are written from it; an empty one is left alone."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                write(batch, batch_id)
        finally:
            batch.unpersist()

    return run


def write_parquet(folder: str) -> Callable[[DataFrame, int], None]:
    """Both tables, a folder for each batch: a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{PROCESSED}/batch={batch_id}")
        batch.where("is_flagged").write.mode("overwrite").parquet(f"{folder}/{FLAGGED}/batch={batch_id}")

    return _once_read(write)


def write_table(folder: str, table: str) -> Callable[[DataFrame, int], None]:
    """One table, such as the rejects, a folder for each batch."""
    return _once_read(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch_id}"))


def write_jdbc(url: str | None = None) -> Callable[[DataFrame, int], None]:
    """Both tables by JDBC. A batch that ended before is passed over; of one that was begun but did not end, only the rows
    are appended that a table does not hold yet, in the batch's span of time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        database = Database(batch.sparkSession, url)
        log = BatchLog(database)
        states = log.states(batch_id)
        if "ended" in states:
            return
        if "begun" not in states:
            log.note(batch_id, "begun")
        first, last = batch.agg(F.min("event_timestamp"), F.max("event_timestamp")).first()
        for table, rows in ((PROCESSED, batch), (FLAGGED, batch.where("is_flagged"))):
            if "begun" in states and database.has(table):
                there = database.read(table).where(F.col("event_timestamp").between(F.lit(first), F.lit(last))).select("transaction_id")
                rows = rows.join(there, "transaction_id", "left_anti").select(*batch.columns)
            database.append(rows, table)
        log.note(batch_id, "ended")

    return _once_read(write)


def write_kafka(tx: DataFrame, broker: str, topic: str) -> None:
    options = {"kafka.bootstrap.servers": broker, "topic": topic, "kafka.acks": "all", "kafka.retries": "5", "kafka.linger.ms": "10"}
    to_messages(tx).write.format("kafka").options(**options).save()


def start(results: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    out = results.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The processed rows and the flagged ones as they were written, without the batch they came in."""
    return tuple(spark.read.parquet(f"{folder}/{table}").drop("batch") for table in (PROCESSED, FLAGGED))
