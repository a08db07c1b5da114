"""Spark-native behavioural analytics over per-account transaction streams."""

__version__ = "0.1.0"
