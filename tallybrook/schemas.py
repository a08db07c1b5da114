"""Schemas of messages and of results."""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(columns: str) -> T.StructType:
    """`name kind, ...` without a session, which workers do not have."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


MESSAGE = _schema("transaction_id string, account_id string, amount double, merchant string, location string, timestamp string, injected_label string")
TRANSACTION = _schema("transaction_id string, account_id string, amount double, merchant string, location string, event_timestamp timestamp, injected_label string")
RESULT = T.StructType(
    TRANSACTION.fields
    + _schema(
        "flag_velocity boolean, flag_amount boolean, flag_geo boolean, is_flagged boolean, triggered_rules string, "
        "velocity_count_5min int, velocity_ratio_to_baseline double, amount_ratio_to_avg double, implied_speed_kmh double"
    ).fields
)
FEATURES = _schema(
    "ms long, prev_location string, prev_ms long, prior_count long, prior_mean double, velocity_count int, window_no long, window_start long, baseline_count long, baseline_mean double"
)
EXPLANATION = _schema("transaction_id string, explanation string, explained_at timestamp")
