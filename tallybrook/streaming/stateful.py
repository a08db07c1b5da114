"""Streaming features: the same columns as operators.features, from keyed state."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallybrook.config import WINDOW_MS
from tallybrook.operators.rules import results, with_rules
from tallybrook.schemas import FEATURES, TRANSACTION

_STATE = "last_location string, last_ms long, amounts long, amount_sum double, events long, window_start long, window_no long, before_window long"


class RecentTimes:
    """The times within five minutes before the newest asked for, and any later ones, in order, whatever order they come in."""

    def __init__(self, times: list[int]):
        self.times, self.first = sorted(times), 0

    def add(self, ms: int) -> int:
        """The number of times from five minutes before ms on, this one included; earlier ones are dropped for good."""
        insort(self.times, ms, lo=self.first)
        self.first = bisect_left(self.times, ms - WINDOW_MS, lo=self.first)
        return len(self.times) - self.first

    def left(self) -> list[int]:
        return self.times[self.first :]


class AccountFeatures(StatefulProcessor):
    """Each batch's events of an account are taken in event order; sums and counts are kept rather than means, so
    that batch and stream agree to the last bit where the order does. Late events, of a later batch with an earlier time, count in
    arrival order. With `ttl_ms`, an account's state goes when it has not been seen for so long; else it is kept for ever."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", _STATE, self.ttl_ms)
        self.recent = handle.getListState("recent", "ms long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ms", "transaction_id"], kind="stable")
        place, last, amounts, total, events, start, number, before = self.account.get() if self.account.exists() else (None, None, 0, 0.0, 0, None, 0, 0)
        recent = RecentTimes([r[0] for r in self.recent.get()] if self.recent.exists() else [])
        made = []
        for ms, amount, location in zip(frame.ms.tolist(), frame.amount.tolist(), frame.location.tolist(), strict=True):
            count = recent.add(ms)
            if start is None or ms - start >= WINDOW_MS:
                start, number, before = ms, number + 1, events
            done = number - 1
            made.append((place, last, amounts, total / amounts if amounts else 0.0, count, number, start, done, before / done if done else 0.0))
            if amount is not None and not math.isnan(amount):
                amounts, total = amounts + 1, total + amount
            events += 1
            place, last = (location if isinstance(location, str) else None), ms
        self.account.update((place, last, amounts, total, events, start, number, before))
        self.recent.put([(t,) for t in recent.left()])
        names = [n for n in FEATURES.fieldNames() if n != "ms"]
        found = pd.DataFrame(made, columns=names, index=frame.index)
        found["prev_ms"] = found["prev_ms"].astype("Int64")
        yield pd.concat([frame, found], axis=1)[[*TRANSACTION.fieldNames(), *FEATURES.fieldNames()]]

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_features(tx: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    use_rocksdb(tx.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*TRANSACTION.fields, *FEATURES.fields])
    keyed = tx.withColumn("ms", F.unix_millis("event_timestamp")).groupBy("account_id")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.transformWithStateInPandas(AccountFeatures(ttl_ms), outputStructType=schema, outputMode="Update", timeMode=mode)


def stream_detect(tx: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return results(with_rules(stream_features(tx, ttl_ms)))
