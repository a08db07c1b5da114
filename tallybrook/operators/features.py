"""Event-time features of each account's history, each computed before the event itself counts.

All share one partitioning by account, so events are read once and shuffled once. One account's events are
sorted in one task, as each depends on those before it; no account's history is held as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallybrook.config import WINDOW_MS


def _ordered() -> WindowSpec:
    return Window.partitionBy("account_id").orderBy("ms", "transaction_id")


def _rows(end: int) -> WindowSpec:
    return _ordered().rowsBetween(Window.unboundedPreceding, end)


def with_order(tx: DataFrame) -> DataFrame:
    """ms and rn, an event's place in its account's history."""
    tx = tx.withColumn("ms", F.unix_millis("event_timestamp"))
    return tx.withColumn("rn", F.row_number().over(_ordered()).cast("long"))


def with_previous(df: DataFrame) -> DataFrame:
    return df.withColumns({"prev_location": F.lag("location").over(_ordered()), "prev_ms": F.lag("ms").over(_ordered())})


def with_amount_history(df: DataFrame) -> DataFrame:
    """Count and mean of the earlier amounts; null and NaN amounts are passed over."""
    usable = F.when(~F.isnan("amount"), F.col("amount"))
    return df.withColumns({"prior_count": F.count(usable).over(_rows(-1)), "prior_mean": F.coalesce(F.avg(usable).over(_rows(-1)), F.lit(0.0))})


def with_sliding_count(df: DataFrame) -> DataFrame:
    """Events of the last five minutes up to this one, both ends included."""
    recent = Window.partitionBy("account_id").orderBy("ms").rangeBetween(-WINDOW_MS, 0)
    return df.withColumn("velocity_count", (F.col("rn") - F.min("rn").over(recent) + 1).cast("int"))


def with_windows(df: DataFrame) -> DataFrame:
    """window_no, window_start and the events before the window, of each event's anchored window.

    A window is opened by the first event, and by each that is five minutes or more after the one that opened the last. A pause
    of five minutes always opens one, so the stretches between such pauses are folded apart; only a stretch's events are
    one array. Grouping by account and stretch needs no other shuffle than that by account."""
    pause = F.coalesce(F.col("ms") - F.lag("ms").over(_ordered()) >= WINDOW_MS, F.lit(True))
    df = df.withColumn("pause", pause.cast("int")).withColumn("stretch", F.sum("pause").over(_rows(0))).drop("pause")
    names = [c for c in df.columns if c not in ("account_id", "stretch")]
    stretches = df.groupBy("account_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("rn", *(c for c in names if c != "rn")))).alias("events"))
    place = "struct<at:int,rn:bigint,ms:bigint>"
    none = F.array().cast(f"array<{place}>")
    opened = lambda e, i: F.struct(i.cast("int").alias("at"), e["rn"].alias("rn"), e["ms"].alias("ms"))
    indexed = F.transform("events", opened)
    heads = F.aggregate(
        indexed, F.struct(none.alias("heads"), F.lit(None).cast("bigint").alias("last")),
        lambda a, x: F.when(a["last"].isNull() | (x["ms"] - a["last"] >= WINDOW_MS), F.struct(F.concat(a["heads"], F.array(x)).alias("heads"), x["ms"].alias("last"))).otherwise(a),
        lambda a: a["heads"],
    )
    spans = stretches.withColumn("heads", heads).select(
        "account_id", F.posexplode(F.transform("heads", lambda h, i: F.struct(
            h.alias("head"), F.slice("events", h["at"] + 1, F.coalesce(F.get("heads", i + 1)["at"], F.size("events")) - h["at"]).alias("own")))).alias("no", "span"),
    )
    events = spans.select("account_id", F.col("span.head.ms").alias("window_start"), (F.col("span.head.rn") - 1).alias("before_window"), F.inline("span.own"))
    opens = (F.col("rn") == F.col("before_window") + 1).cast("long")
    return events.withColumn("window_no", F.sum(opens).over(_rows(0)))


def with_baseline(df: DataFrame) -> DataFrame:
    """Number and mean count of the completed windows: they hold all events before this window."""
    done = F.col("window_no") - 1
    return df.withColumns({"baseline_count": done, "baseline_mean": F.when(done > 0, F.col("before_window") / done).otherwise(F.lit(0.0))}).drop("before_window")


def features(tx: DataFrame) -> DataFrame:
    return with_baseline(with_windows(with_sliding_count(with_amount_history(with_previous(with_order(tx))))))
