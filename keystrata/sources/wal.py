"""The write-ahead log: an append-only table of numbered segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import base_key, value_type
from ..operators.integrity import record_crc
from ..operators.versions import latest

SCHEMA = "k string, value string, tombstone boolean, ts long, seq long, crc long, segment long"


def segment_name(segment):
    """Five digits, or as many as the number has."""
    return F.format_string("wal_%05d.log", segment.cast("long"))


def stamped(ops: DataFrame, segment_rows: int, first_seq: int = 0) -> DataFrame:
    """Operations (k, value, tombstone, ts, seq) with checksum and segment,
    counted from 1. Numbers run from ``first_seq`` without gaps, so a segment
    holds ``segment_rows`` records; ``numbered`` makes them so."""
    crc = record_crc(F.col("k"), F.col("value"), F.col("tombstone"), F.col("ts"))
    segment = F.floor((F.col("seq") - first_seq) / segment_rows) + 1
    return ops.withColumn("crc", crc).withColumn("segment", segment.cast("long"))


def marked(ops: DataFrame) -> DataFrame:
    """``ops`` with ``__at``, their order: the partition, then the place in it."""
    return ops.withColumn("__at", F.monotonically_increasing_id())


def numbered(marked: DataFrame, first: int = 0) -> DataFrame:
    """Rows that ``marked`` gave, stored in between, with ``seq`` from
    ``first`` on, without gaps, in their order: what each partition held is
    counted, and a row a partition is summed."""
    part = F.shiftright("__at", 33)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sizes.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + first).alias("__base"))
    placed = marked.withColumn("__part", part).join(F.broadcast(base), "__part")
    return placed.withColumn("seq", F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__base")


def append(ops: DataFrame, path: str, segment_rows: int) -> None:
    stamped(ops, segment_rows).select("k", "value", "tombstone", "ts", "seq", "crc", "segment").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def checked(log: DataFrame) -> DataFrame:
    """``log`` with ``valid``: the checksum holds."""
    return log.withColumn("valid", F.col("crc") == record_crc(F.col("k"), F.col("value"), F.col("tombstone"), F.col("ts")))


def replayed(log: DataFrame) -> DataFrame:
    """What a memtable holds after replay; records that fail their checksum are
    left to ``checked(...)`` and not applied."""
    good = checked(log).filter("valid")
    return latest(good.withColumn("base_key", base_key(F.col("k"))).withColumn("value_type", value_type(F.col("k"))))


def segment_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(segment_name(F.col("segment")).alias("segment")).agg(F.count("*").alias("n"))


def truncated(log: DataFrame, low_water: int) -> DataFrame:
    """The newest ``low_water`` - 1 segments, numbered from 1; 0 keeps all."""
    if low_water == 0:
        return log
    last = log.agg(F.max("segment").alias("m")).first()["m"] or 0
    gone = max(0, last - (low_water - 1))
    return log.filter(F.col("segment") > gone).withColumn("segment", F.col("segment") - gone)
