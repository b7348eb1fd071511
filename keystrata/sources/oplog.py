"""An operation log from the ``events`` table, and its simulated level-0 runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import base_key, value_type
from ..operators.versions import latest

RUN_OPS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, base_key, value_type, value, tombstone, ts, seq and run: a user's
    events are its key's versions; errors delete."""
    kind = F.col("event_type")
    suffix = F.when(kind == "signup", "-hll").when(kind == "view", "-cms").otherwise("")
    log = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), suffix).alias("k"),
        F.when(kind == "error", "").otherwise(F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"),
        (kind == "error").alias("tombstone"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / RUN_OPS).alias("run"),
    )
    return log.withColumn("base_key", base_key(F.col("k"))).withColumn("value_type", value_type(F.col("k")))


def level0(log: DataFrame) -> DataFrame:
    """One run for each RUN_OPS operations: the memtable flushed at that size."""
    runs = log.withColumn("level", F.lit(0).cast("long")).withColumn("gen", F.col("run"))
    return latest(runs, "level", "gen")
