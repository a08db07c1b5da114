"""Distances between countries as column expressions and as a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.config import COUNTRIES, EARTH_KM


def centroids(spark: SparkSession) -> DataFrame:
    """code, lat, lon and name: 15 rows."""
    return spark.createDataFrame(COUNTRIES, "code string, lat double, lon double, name string")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2.0)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(chord))


def pairs(spark: SparkSession) -> DataFrame:
    """from_code, to_code and km of the 210 ordered pairs of countries."""
    a, b = centroids(spark).alias("a"), centroids(spark).alias("b")
    joined = a.join(F.broadcast(b), F.col("a.code") != F.col("b.code"))
    return joined.select(F.col("a.code").alias("from_code"), F.col("b.code").alias("to_code"), haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("km"))


def with_distance(df: DataFrame, start: str, end: str, name: str = "km") -> DataFrame:
    """Adds the distance between two country codes; 0 where one is unknown or null, or both are the same."""
    table = pairs(df.sparkSession).select(F.col("from_code").alias("_from"), F.col("to_code").alias("_to"), F.col("km").alias("_km"))
    joined = df.join(F.broadcast(table), (F.col(start) == F.col("_from")) & (F.col(end) == F.col("_to")), "left")
    return joined.withColumn(name, F.coalesce("_km", F.lit(0.0))).drop("_from", "_to", "_km")
