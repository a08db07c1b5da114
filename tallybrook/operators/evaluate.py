"""Rules against injected labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.config import LABEL_OF_RULE, MAX_SPEED_KMH, SWEEP
from tallybrook.operators.rules import velocity_flag


def _labelled(label: str) -> Column:
    return F.coalesce(F.col("injected_label") == label, F.lit(False))


def _confusion(flag: Column, truth: Column) -> list[Column]:
    return [F.count_if(flag & truth).alias("tp"), F.count_if(flag & ~truth).alias("fp"), F.count_if(~flag & truth).alias("fn")]


def _rates(sums: DataFrame) -> DataFrame:
    part = lambda other: F.round(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(other)).cast("double")), 4)
    return sums.withColumns({"precision": part("fp"), "recall": part("fn")})


def quality(df: DataFrame, flag: Column, truth: Column) -> DataFrame:
    return _rates(df.agg(*_confusion(flag, truth)))


def by_rule(df: DataFrame) -> DataFrame:
    """All rules' counts in one pass, a row for each rule."""
    each = [F.struct(*_confusion(F.col(f"flag_{r}"), _labelled(label)), F.lit(r).alias("rule")).alias(r) for r, label in LABEL_OF_RULE.items()]
    return _rates(df.agg(*each).select(F.inline(F.array(*LABEL_OF_RULE)))).select("tp", "fp", "fn", "precision", "recall", "rule")


def overall(df: DataFrame) -> DataFrame:
    return quality(df, F.col("is_flagged"), F.col("injected_label").isNotNull())


def velocity_sweep(df: DataFrame, factors: tuple[float, ...] = SWEEP) -> DataFrame:
    """Flags at each factor, on unrounded values, in one pass."""
    truth = _labelled(LABEL_OF_RULE["velocity"])
    sums = df.agg(*(a for i, k in enumerate(factors) for a in (F.count_if(velocity_flag(k)).alias(f"f{i}"), F.count_if(velocity_flag(k) & truth).alias(f"t{i}"))))
    rows = F.array(*(F.struct(F.lit(k).alias("factor"), F.col(f"f{i}").alias("flagged"), F.col(f"t{i}").alias("tp")) for i, k in enumerate(factors)))
    return sums.select(F.inline(rows))


def straddle(df: DataFrame) -> DataFrame:
    travelled = df.where(_labelled(LABEL_OF_RULE["geo"]) & (F.col("speed") > 0))
    return travelled.groupBy((F.col("speed") > MAX_SPEED_KMH).alias("above"), "flag_geo").agg(F.count("*").alias("n"))


def echoes(df: DataFrame) -> DataFrame:
    """Travel flags by what was injected just before them."""
    before = F.lag("injected_label").over(Window.partitionBy("account_id").orderBy("ms", "transaction_id"))
    seen = df.withColumn("label_before", F.coalesce(before, F.lit("none"))).where("flag_geo")
    return seen.groupBy("label_before", F.coalesce("injected_label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


def speeds(df: DataFrame) -> DataFrame:
    """Number, median and minimum of the speeds of labelled travel. Speeds are counted by tenths, as they are reported, before they are ordered."""
    travelled = df.where(_labelled(LABEL_OF_RULE["geo"]) & F.col("prev_ms").isNotNull() & (F.col("speed") > 0))
    cells = travelled.groupBy(F.round("speed", 1).alias("speed")).agg(F.count("*").alias("c"))
    return cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.round(F.percentile("speed", 0.5, F.col("c")), 1).alias("median_speed"), F.min("speed").alias("min_speed"))


def window_ratios(df: DataFrame) -> DataFrame:
    found = df.where("baseline_count >= 1").withColumn("r", F.col("velocity_count") / F.col("baseline_mean"))
    return found.groupBy(F.coalesce("injected_label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.round(F.max("r"), 6).alias("max_ratio"))
