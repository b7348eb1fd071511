"""Which version of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = ("base_key", "value_type", "value", "tombstone", "ts", "seq")


def latest(log: DataFrame, *within: str) -> DataFrame:
    """The newest version of each base key, by ts, then seq; tombstones
    included. ``within`` names columns whose groups are kept apart.

    An aggregate, so versions are reduced before the shuffle, and a filter on
    the key passes below it to the scan.
    """
    keys = [*within, "base_key"]
    rest = [c for c in VERSION if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("v")
    return log.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"v.{c}").alias(c) for c in rest))


def live(log: DataFrame, *within: str) -> DataFrame:
    """The newest versions that are not deletions."""
    return latest(log, *within).filter(~F.col("tombstone")).drop("tombstone")


def as_of(log: DataFrame, ts: int | Column) -> DataFrame:
    """The live view at a time in the past."""
    return live(log.filter(F.col("ts") <= ts))
