"""Account risk from flagged transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.config import RECENT_FLAGS, RULES
from tallybrook.functions.labels import iso, precision_hundredths, risk_level


def flagged(processed: DataFrame) -> DataFrame:
    return processed.where("is_flagged")


def rule_hits(processed: DataFrame) -> DataFrame:
    """One row for each rule that a transaction tripped."""
    return flagged(processed).select("account_id", "transaction_id", F.explode(F.split("triggered_rules", ",")).alias("rule"))


def _totals() -> list[Column]:
    points = F.aggregate(F.split("triggered_rules", ","), F.lit(0), lambda a, r: a + precision_hundredths(r))
    by_rule = [F.count_if(F.col("is_flagged") & F.array_contains(F.split("triggered_rules", ","), r)).alias(f"{r}_flags") for r in sorted(RULES)]
    return [
        F.count("*").alias("total_processed_transactions"), F.count_if("is_flagged").alias("total_flags"), *by_rule,
        F.coalesce(F.sum(F.when(F.col("is_flagged"), points)), F.lit(0)).alias("points"),
    ]


def _scored(totals: DataFrame) -> DataFrame:
    score = F.col("points") / 100.0
    return totals.withColumn("risk_score", F.round(score, 2)).withColumn("risk_level", risk_level(score)).drop("points")


def scores(processed: DataFrame) -> DataFrame:
    """Totals, counts by rule, score and level of every account that has transactions."""
    return _scored(processed.groupBy("account_id").agg(*_totals()))


def _places() -> Column:
    newest = Window.partitionBy("account_id", "is_flagged").orderBy(F.desc("event_timestamp"), F.desc("transaction_id"))
    return F.row_number().over(newest)


def recent(processed: DataFrame, n: int = RECENT_FLAGS) -> DataFrame:
    """The newest flagged transactions of each account, with their place."""
    return flagged(processed).withColumn("place", _places()).where(F.col("place") <= n)


def status(processed: DataFrame, explained: DataFrame | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """The risk document of each account (of `accounts`, also of those without any transaction).

    `processed` is read once: totals and the newest flags come from the same groups, and explanations are joined to the latter."""
    item = F.struct("place", "transaction_id", iso(F.col("event_timestamp")).alias("event_timestamp"), "amount", "merchant", "location", F.split("triggered_rules", ",").alias("triggered_rules"), "injected_label")
    shown = F.collect_list(F.when(F.col("is_flagged") & (F.col("place") <= RECENT_FLAGS), item))
    known = _scored(processed.withColumn("place", _places()).groupBy("account_id").agg(*_totals(), F.sort_array(shown).alias("recent_flags")))
    names = [c for c in known.columns if c not in ("account_id", "recent_flags")]
    if explained is not None:
        single = known.select("account_id", *names, F.explode_outer("recent_flags").alias("flag")).withColumn("transaction_id", F.col("flag.transaction_id"))
        single = single.join(explained.select("transaction_id", "explanation"), "transaction_id", "left")
        whole = F.when(F.col("flag").isNotNull(), F.col("flag").withField("explanation", F.col("explanation")))
        known = single.groupBy("account_id").agg(*(F.first(c).alias(c) for c in names), F.sort_array(F.collect_list(whole)).alias("recent_flags"))
    else:
        known = known.withColumn("recent_flags", F.transform("recent_flags", lambda x: x.withField("explanation", F.lit(None).cast("string"))))
    if accounts is not None:
        known = accounts.select("account_id").join(known, "account_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = F.create_map(*(x for r in sorted(RULES) for x in (F.lit(r), zero(f"{r}_flags").cast("int"))))
    return known.select(
        "account_id", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("risk_level", F.lit("none")).alias("risk_level"),
        zero("total_flags").alias("total_flags"), zero("total_processed_transactions").alias("total_processed_transactions"), counts.alias("flags_by_rule"),
        F.get("recent_flags", F.lit(0))["explanation"].alias("last_explanation"),
        F.coalesce(F.transform("recent_flags", lambda x: x.dropFields("place")), F.array()).alias("recent_flags"),
    )


def account_status(processed: DataFrame, account_id: str, explained: DataFrame | None = None) -> dict:
    """One account's document, also of an unknown one; the id is bound as a literal."""
    one = processed.sparkSession.createDataFrame([(account_id,)], "account_id string")
    return status(processed.where(F.col("account_id") == F.lit(account_id)), explained, one).first().asDict(recursive=True)
