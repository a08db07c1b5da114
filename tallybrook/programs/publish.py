"""Publishes seeded transactions to a broker, as many turns a second as asked."""

from __future__ import annotations

import argparse
import time
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.programs import session
from tallybrook.sources import generator
from tallybrook.streaming import sinks

#: Seconds of turns that are sent at once, and seconds that are generated at once where the end is open.
PERIOD, STRETCH = 5.0, 3600.0


def parts(spark: SparkSession, given: argparse.Namespace, seed: int, now: Callable[[], float]) -> Iterator[tuple[float, DataFrame]]:
    """When to send, in seconds from the start, and what: the turns of each period. Stretches of an open end have seeds of their own."""
    begun, offset = now(), 0.0
    while given.duration is None or offset < given.duration:
        seconds = STRETCH if given.duration is None else min(STRETCH, given.duration - offset)
        turns = max(1, round(seconds * given.rate))
        start = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(begun + offset))
        tx = generator.transactions(spark, turns, given.rate, given.accounts, given.anomaly_rate, given.injection_mode, seed, start)
        tx = tx.withColumn("turn", F.substring("transaction_id", 1, 12).cast("long")).persist()
        each = max(1, round(PERIOD * given.rate))
        for first in range(0, turns, each):
            yield offset + first / given.rate, tx.where(F.col("turn").between(first, min(first + each, turns) - 1)).drop("turn")
        tx.unpersist()
        offset, seed = offset + seconds, seed + 1


def run(
    spark: SparkSession, given: argparse.Namespace, send: Callable[[DataFrame], None] | None = None, seed: int = 42, now: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep, say: Callable[[str], None] = print,
) -> Counter:
    """Sends until the duration is over, or until it is interrupted; what was sent, by label."""
    if given.rate <= 0:
        raise SystemExit("the rate has to be more than 0")
    send = send or (lambda tx: sinks.write_kafka(tx, given.broker, given.topic))
    sent: Counter = Counter()
    begun = now()
    say(f"publishing to '{given.topic}' on {given.broker}, {given.rate} turns a second")
    try:
        for due, tx in parts(spark, given, seed, now):
            sleep(max(0.0, begun + due - now()))
            try:
                send(tx)
            except Exception as error:
                if sent:
                    raise
                raise SystemExit(f"no broker can be reached at {given.broker}: {error}") from error
            sent.update({r.label: r.n for r in generator.label_counts(tx).collect()})
            say(f"sent={sum(sent.values())} " + " ".join(f"{k}={v}" for k, v in sorted(sent.items())))
    except KeyboardInterrupt:
        say("stopped")
    return sent


def main(args: list[str] | None = None) -> None:
    run(session("publish"), generator.arguments(args))


if __name__ == "__main__":
    main()
