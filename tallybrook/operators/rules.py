"""Rules over feature columns; batch and streaming share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook import config as C
from tallybrook.functions import geo
from tallybrook.operators.features import features
from tallybrook.schemas import RESULT


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to compare with, or nothing to compare."""
    found = F.when(whole > 0, part / whole)
    return F.coalesce(F.when(~F.isnan(found), found), F.lit(0.0))


def velocity_flag(factor: float | Column = C.VELOCITY_FACTOR) -> Column:
    return (F.col("baseline_count") >= C.VELOCITY_MIN_WINDOWS) & (F.col("velocity_count") > F.col("baseline_mean") * factor)


def amount_flag() -> Column:
    high = ~F.isnan("amount") & (F.col("amount") > F.col("prior_mean") * C.AMOUNT_FACTOR)
    return (F.col("prior_count") >= C.AMOUNT_MIN_PRIOR) & F.coalesce(high, F.lit(False))


def with_speed(df: DataFrame) -> DataFrame:
    """speed, from the account's last place to this one."""
    df = geo.with_distance(df, "prev_location", "location")
    hours = F.greatest((F.col("ms") - F.col("prev_ms")) / 3_600_000.0, F.lit(C.MIN_HOURS))
    return df.withColumn("speed", F.when(F.col("km") > 0, F.col("km") / hours).otherwise(F.lit(0.0))).drop("km")


def with_rules(df: DataFrame) -> DataFrame:
    """All flags and measures beside the feature columns."""
    df = with_speed(df)
    df = df.withColumns({"flag_velocity": velocity_flag(), "flag_amount": amount_flag(), "flag_geo": F.col("speed") > C.MAX_SPEED_KMH})
    names = [F.when(F.col(f"flag_{r}"), r) for r in C.RULES]
    return df.withColumns(
        {
            "is_flagged": F.col("flag_velocity") | F.col("flag_amount") | F.col("flag_geo"),
            "triggered_rules": F.concat_ws(",", *names),
            "velocity_count_5min": F.col("velocity_count"),
            "velocity_ratio_to_baseline": F.round(ratio(F.col("velocity_count"), F.col("baseline_mean")), 3),
            "amount_ratio_to_avg": F.round(ratio(F.col("amount"), F.col("prior_mean")), 3),
            "implied_speed_kmh": F.round("speed", 1),
        }
    )


def results(df: DataFrame) -> DataFrame:
    return df.select(*RESULT.fieldNames())


def detect(tx: DataFrame) -> DataFrame:
    return results(with_rules(features(tx)))
