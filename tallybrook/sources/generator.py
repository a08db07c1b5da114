"""A seeded stream of labelled transactions as a DataFrame.

Draws are hashes of seed, row and purpose, so the stream is the same on any number of partitions.
"""

from __future__ import annotations

import argparse
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.config import CODES, MERCHANTS, Settings
from tallybrook.functions import geo

SPEEDS = {"borderline": (1000.0, 3000.0), "straddle": (700.0, 1100.0)}
ANOMALIES = ("impossible_travel", "amount_spike", "velocity_burst")
SPIKE, BURST, DEVIATION, BURST_DEVIATION = (8.0, 25.0), (4, 8), 0.25, 0.15


def uniform(seed: int, purpose: str, *keys: str | Column) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 40)) / float(1 << 40)


def pick(values: list[str], u: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int"))


def normal(seed: int, purpose: str, *keys: str | Column) -> Column:
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, f"{purpose}-r", *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, f"{purpose}-a", *keys))


def accounts(spark: SparkSession, n: int = 500) -> DataFrame:
    """Identities depend on the account's number alone, so they are the same in every run."""
    home, mean = pick(CODES, uniform(0, "home", "id")), F.round(30 + 270 * uniform(0, "mean", "id"), 2)
    return spark.range(n).select("id", F.format_string("acct_%05d", "id").alias("account_id"), home.alias("home"), mean.alias("historical_avg"))


def transactions(
    spark: SparkSession, n: int, rate: float = 5.0, n_accounts: int = 500, anomaly_rate: float = 0.05, mode: str = "random", seed: int = 42, start: str = "2026-01-01 00:00:00"
) -> DataFrame:
    """The events of `n` turns, `rate` a second: each picks an account, and with anomaly_rate one of three anomalies.

    An account's clock never goes back: travel that is timed to a speed moves it ahead, and later events follow.
    In `borderline` and `straddle` mode a first event is never injected travel."""
    u = lambda purpose, *k: uniform(seed, purpose, *(k or ("turn",)))
    turns = spark.range(n).withColumnRenamed("id", "turn").select(
        "turn", F.floor(u("account") * n_accounts).alias("id"),
        F.when(u("odd") < anomaly_rate, pick(list(ANOMALIES), u("kind"))).alias("injected_label"),
    )
    size = F.when(F.col("injected_label") == "velocity_burst", BURST[0] + F.floor(u("size") * (BURST[1] - BURST[0] + 1))).otherwise(1)
    rows = turns.withColumn("part", F.explode(F.sequence(F.lit(1), size.cast("int")))).join(F.broadcast(accounts(spark, n_accounts)) if n_accounts <= 100_000 else accounts(spark, n_accounts), "id")
    spread = F.when(F.col("injected_label") == "velocity_burst", BURST_DEVIATION).otherwise(DEVIATION)
    ordinary = F.greatest(F.lit(1.0), F.col("historical_avg") * (1 + spread * normal(seed, "amount", "turn", "part")))
    spike = F.col("historical_avg") * (SPIKE[0] + (SPIKE[1] - SPIKE[0]) * u("spike"))
    rows = rows.withColumn("amount", F.round(F.when(F.col("injected_label") == "amount_spike", spike).otherwise(ordinary), 2))
    by_account = Window.partitionBy("account_id").orderBy("turn", "part")
    codes = F.array(*map(F.lit, CODES))
    other = lambda here: F.get(F.array_except(codes, F.array(here)), F.floor(u("abroad") * (len(CODES) - 1)).cast("int"))
    base = F.unix_millis(F.to_timestamp(F.lit(start))) + F.floor(F.col("turn") * 1000 / rate) + F.col("part") - 1
    rows = rows.withColumn("base", base)
    travel = F.col("injected_label") == "impossible_travel"
    if mode == "random":
        rows = rows.withColumns({"location": F.when(travel, other(F.col("home"))).otherwise(F.col("home")), "delay": F.lit(0)})
    else:
        low, high = SPEEDS[mode]
        first = F.row_number().over(by_account) == 1
        rows = rows.withColumn("injected_label", F.when(~F.coalesce(travel, F.lit(False)) | ~first, F.col("injected_label")))
        # travel starts where the account is: at home, or where travel just before took it. The second of two goes
        # home, and one that would then stay where it is is no travel
        travel = F.coalesce(travel, F.lit(False))
        follows = F.coalesce(F.lag(travel).over(by_account), F.lit(False))
        rows = rows.withColumn("location", F.when(travel & ~follows, other(F.col("home"))).otherwise(F.col("home"))).withColumn("last", F.lag("location").over(by_account))
        rows = geo.with_distance(rows, "last", "location").withColumn("injected_label", F.when(~travel | (F.col("km") > 0), F.col("injected_label")))
        speed = low + (high - low) * u("speed")
        rows = rows.withColumn("delay", F.when(travel & (F.col("km") > 0), F.ceil(F.col("km") / speed * 3_600_000)).otherwise(0)).drop("km", "last")
    # clock: each event is at its base or at the last event's time, whichever is later, plus its delay
    total = F.sum("delay").over(by_account.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("total", total)
    lead = F.max(F.col("base") - (F.col("total") - F.col("delay"))).over(by_account.rowsBetween(Window.unboundedPreceding, 0))
    stamp = F.timestamp_millis((F.col("total") + lead).cast("long"))
    return rows.select(
        F.concat_ws("-", F.lpad(F.col("turn").cast("string"), 12, "0"), F.lpad(F.col("part").cast("string"), 2, "0"), F.substring(F.sha2(F.concat_ws("-", F.lit(seed), "turn", "part"), 256), 1, 12)).alias("transaction_id"), "account_id", "amount", pick(MERCHANTS, u("merchant", "turn", "part")).alias("merchant"),
        "location", stamp.alias("event_timestamp"), "injected_label",
    )


def label_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.coalesce("injected_label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    at = Settings.from_environment()
    parser = argparse.ArgumentParser(description="Publish seeded transactions to a broker.")
    for flag, kind, default in (("--rate", float, 5.0), ("--broker", str, at.broker), ("--topic", str, at.topic), ("--accounts", int, 500), ("--anomaly-rate", float, 0.05), ("--duration", float, None)):
        parser.add_argument(flag, type=kind, default=default)
    parser.add_argument("--injection-mode", choices=["random", *SPEEDS], default="random")
    return parser.parse_args(args)
