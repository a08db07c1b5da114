"""Programs: publish transactions, detect, explain, serve. Each runs as `python -m tallybrook.programs.NAME`."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
