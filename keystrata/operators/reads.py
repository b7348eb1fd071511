"""Point lookups, prefix lists, closed ranges, pages and what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import display
from .versions import latest, live


def get(log: DataFrame, key: str) -> DataFrame:
    """The live version of one base key: a row, or none."""
    return live(log.filter(F.col("base_key") == key.split("-")[0]))


def prefix(log: DataFrame, start: str) -> DataFrame:
    return live(log.filter(F.startswith("base_key", F.lit(start))))


def between(log: DataFrame, low: str, high: str) -> DataFrame:
    """The live keys of a closed range; bounds are cut at a hyphen as keys are."""
    low, high = low.split("-")[0], high.split("-")[0]
    if low > high:
        raise ValueError("the lower bound is above the upper one")
    return live(log.filter(F.col("base_key").between(low, high)))


def page(found: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number``, from 1, of live rows in key order: each task keeps only
    its first number * size rows. Pages past the end are empty."""
    if number < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    return found.orderBy("base_key").offset(size * (number - 1)).limit(size)


def shown(rows: DataFrame, number: int, size: int) -> DataFrame:
    """A page as printed: row number in the whole list, key, value or label."""
    place = F.row_number().over(Window.orderBy("base_key")) + size * (number - 1)  # over one page
    return rows.select(place.cast("long").alias("row_no"), "base_key", display(F.col("value_type"), F.col("value")).alias("shown"))


def ordered(log: DataFrame) -> DataFrame:
    """All entries in key order, deletions included."""
    return latest(log).orderBy("base_key")


def by_type(log: DataFrame) -> DataFrame:
    """How many live keys hold each type of value."""
    return live(log).groupBy("value_type").agg(F.count("*").alias("n"))
