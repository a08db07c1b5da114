"""Streaming programs over files or a broker."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tallybrook.sources.transactions import from_events, parse_messages, split_rejects, stream
from tallybrook.streaming import sinks
from tallybrook.streaming.stateful import stream_detect

REJECTS = "rejected_transactions"


def scratch(spark: SparkSession) -> str:
    """A folder in the shared place that spark.checkpoint.dir names; a temporary one where it names none and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallybrook-stream-')}"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


class Progress(StreamingQueryListener):
    """Says how many rows each batch had."""

    def __init__(self, say: Callable[[str], None] = print):
        self.say = say

    def onQueryStarted(self, event) -> None:
        self.say(f"stream {event.name or event.id} started")

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.say(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows, {event.progress.processedRowsPerSecond:.1f} a second")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say("stream ended" + (f": {event.exception}" if event.exception else ""))


def write_parts(spark: SparkSession, sf_dir: str, folder: str, parts: int, which: range | None = None) -> None:
    """The test table `events` as files, each of the next span of time: what a stream meets one by one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first, last = events.agg(F.unix_millis(F.min("ts").cast("timestamp")), F.unix_millis(F.max("ts").cast("timestamp"))).first()
    part = F.least(F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - first) * parts / F.lit(last - first + 1)), F.lit(parts - 1))
    for k in which or range(parts):
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def drain(spark: SparkSession, folder: str, files_a_batch: int = 1) -> None:
    """All of the folder's new events through the stateful stream to its two tables, from where the last run ended."""
    schema = spark.read.parquet(f"{folder}/events").schema
    events = stream(spark, "parquet", schema=schema, path=f"{folder}/events", maxFilesPerTrigger=str(files_a_batch))
    sinks.start(stream_detect(from_events(events)), sinks.write_parquet(folder), f"{folder}/checkpoint", available_now=True).awaitTermination()


def stateful_detect(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """The processed rows of a stream of several batches, each of which goes on from the state that the last one left."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = scratch(spark)
    write_parts(spark, sf_dir, folder, parts)
    drain(spark, folder)
    return sinks.read_tables(spark, folder)[0]


def fan_out(spark: SparkSession, sf_dir: str, parts: int = 2) -> DataFrame:
    """Which rows were written to which table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = scratch(spark)
    write_parts(spark, sf_dir, folder, parts)
    drain(spark, folder)
    processed, flagged = (t.select("transaction_id", "is_flagged", "triggered_rules") for t in sinks.read_tables(spark, folder))
    return processed.withColumn("sink", F.lit("processed")).unionByName(flagged.withColumn("sink", F.lit("flagged")))


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed rows of a stream that is stopped half-way and started again from its checkpoint."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = scratch(spark)
    write_parts(spark, sf_dir, folder, 3, range(0, 2))
    drain(spark, folder, files_a_batch=2)
    write_parts(spark, sf_dir, folder, 3, range(2, 3))
    drain(spark, folder, files_a_batch=2)
    return sinks.read_tables(spark, folder)[0]


def run(
    spark: SparkSession, checkpoint: str, url: str | None = None, messages: DataFrame | None = None, write: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = False, ttl_ms: int | None = None,
) -> list[StreamingQuery]:
    """The deployed job: messages of the broker to the two tables, and those that can't be used to a table of rejects beside the checkpoint.

    With `ttl_ms` the stream goes on looking for expired state, so that it never ends by itself, even if it is to stop where all is read."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    parsed = parse_messages(messages if messages is not None else stream(spark, "kafka"), F.col("value"))
    usable, rejects = split_rejects(parsed)
    return [
        sinks.start(stream_detect(usable, ttl_ms), write or sinks.write_jdbc(url), f"{checkpoint}/detect", available_now),
        sinks.start(rejects, sinks.write_table(checkpoint, REJECTS), f"{checkpoint}/rejects", available_now),
    ]
