"""Small lookups and text formats."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybrook.config import COUNTRIES, LEVELS, PRECISION_HUNDREDTHS


def _map(items: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(items.items())))


def country_label(code: Column) -> Column:
    """`DE (Germany)`, or the code itself where it is unknown."""
    return F.coalesce(F.concat(code, F.lit(" ("), F.try_element_at(_map({c: n for c, _, _, n in COUNTRIES}), code), F.lit(")")), code)


def precision_hundredths(rule: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PRECISION_HUNDREDTHS), rule), F.lit(0))


def risk_level(score: Column) -> Column:
    level = F.when(score <= 0, "none")
    for least, name in LEVELS:
        level = level.when(score >= least, name)
    return level.otherwise("low")


def decimals(x: Column, n: int) -> Column:
    """A fixed number of decimals; halves are rounded away from zero."""
    return F.format_string(f"%.{n}f", F.round(x, n))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
