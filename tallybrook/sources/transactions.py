"""Where transactions come from: messages, files, the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.config import CODES, Settings
from tallybrook.schemas import MESSAGE


def from_events(events: DataFrame) -> DataFrame:
    """The test table `events` presented as transactions, with travel and amount anomalies by its k."""
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    codes = F.array(*map(F.lit, CODES))
    place = F.when(k >= 95, F.pmod(user + 1 + k % 14, F.lit(15))).otherwise(F.pmod(user, F.lit(15)))
    spike = F.when(k.between(90, 94), 8 + k % 18).otherwise(1)
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.concat(F.lit("acct_"), F.lpad(user.cast("string"), 5, "0")).alias("account_id"),
        F.round(F.round(100 + F.col("value"), 2) * spike, 2).alias("amount"),
        F.col("event_type").alias("merchant"),
        F.get(codes, place.cast("int")).alias("location"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.when(k >= 95, "impossible_travel").when(k >= 90, "amount_spike").alias("injected_label"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def to_messages(tx: DataFrame) -> DataFrame:
    """key and value (JSON) as a broker takes them."""
    stamp = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    names = [f for f in MESSAGE.fieldNames() if f != "timestamp"]
    body = F.struct(*(F.col(n) for n in names), stamp.alias("timestamp"))
    return tx.select(F.col("account_id").alias("key"), F.to_json(body).alias("value"))


def parse_messages(raw: DataFrame, value: str | Column = "value") -> DataFrame:
    """Typed columns of JSON messages; malformed fields come out as null."""
    value = F.col(value) if isinstance(value, str) else value
    fields = raw.select(F.from_json(value.cast("string"), MESSAGE).alias("d")).select("d.*")
    return fields.withColumn("event_timestamp", F.try_to_timestamp("timestamp")).drop("timestamp")


def unusable() -> Column:
    return F.col("account_id").isNull() | F.col("event_timestamp").isNull()


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions that can be keyed and ordered, and the others, which never reach any state."""
    return parsed.where(~unusable()), parsed.where(unusable())


def stream(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A streaming scan: `kafka` (replay with startingOffsets=earliest), or files of a known schema."""
    if kind == "kafka":
        spark.conf.set("spark.sql.streaming.kafka.useDeprecatedOffsetFetching", "true")
        at = Settings.from_environment()
        defaults = {"kafka.bootstrap.servers": at.broker_internal, "subscribe": at.topic, "startingOffsets": "latest", "maxOffsetsPerTrigger": "200"}
        return spark.readStream.format("kafka").options(**(defaults | options)).load()
    schema, path = options.pop("schema"), options.pop("path")
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)
