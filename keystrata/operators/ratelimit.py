"""A sliding-log rate limiter: an operation passes while fewer than ``number``
passed ones lie within the last ``seconds``."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Limiter:
    """The same for one caller: ``allow`` tells whether an operation passes now."""

    def __init__(self, seconds: int, number: int):
        self.seconds, self.number, self.passed = seconds, number, deque()

    def allow(self, now: float) -> bool:
        while self.passed and now - self.passed[0] >= self.seconds:
            self.passed.popleft()
        if len(self.passed) >= self.number:
            return False
        self.passed.append(now)
        return True


def limited(ops: DataFrame, key: str, seconds: int, number: int, slice_seconds: int | None = None) -> DataFrame:
    """key, ts, seq and accepted of every operation, by ts, then seq.

    What passes depends on what passed before, but where a key pauses for
    ``seconds`` or longer nothing is remembered: its operations are cut there,
    and the pieces are dealt to tasks by their own. Pauses inside a slice of
    time are found in that slice, and those across slices from their first and
    last times, so no task sees a whole key for that either; only operations
    without a pause between them are taken in order by one task, which streams
    them and holds ``number`` times.
    """
    kind = ops.schema[key].dataType.simpleString()
    width = slice_seconds or max(1, 64 * seconds)
    sliced = ops.select(F.col(key).alias("k"), "ts", "seq").withColumn("slice", F.floor(F.col("ts") / width))
    before = F.lag("ts").over(Window.partitionBy("k", "slice").orderBy("ts", "seq"))
    ends = sliced.groupBy("k", "slice").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    earlier = F.lag("last").over(Window.partitionBy("k").orderBy("slice"))  # a row for each slice in which a key is used
    opened = ends.withColumn("earlier", earlier)
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("slice") == F.col("slice2"))
    near = sliced.withColumn("before", before).join(opened.select(F.col("k").alias("k2"), F.col("slice").alias("slice2"), "earlier"), same).drop("k2", "slice2")
    paused = F.col("ts") - F.coalesce("before", "earlier") >= seconds
    marks = near.withColumn("cut", F.coalesce(paused, F.lit(True)))
    starts = F.max(F.when(F.col("cut"), F.col("ts"))).over(Window.partitionBy("k", "slice").orderBy("ts", "seq"))
    marked = marks.withColumn("begun", starts)
    # a slice that begins amid a piece belongs to that of the slices before it
    heads = marked.groupBy("k", "slice").agg(F.max("begun").alias("last_begun"))
    carried = F.last("last_begun", ignorenulls=True).over(Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("carried", carried)
    pieces = marked.join(heads.select(F.col("k").alias("k2"), F.col("slice").alias("slice2"), "carried"), same).select("k", "ts", "seq", F.coalesce("begun", "carried").alias("piece"))
    dealt = pieces.repartition("k", "piece").sortWithinPartitions("k", "piece", "ts", "seq")

    def run(batches):
        own, passed = object(), deque()
        for batch in batches:
            out = []
            for k, piece, ts in zip(batch.column("k").to_pylist(), batch.column("piece").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                if (k, piece) != own:
                    own, passed = (k, piece), deque()
                while passed and ts - passed[0] >= seconds:
                    passed.popleft()
                out.append(len(passed) < number)
                if out[-1]:
                    passed.append(ts)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("ts"), batch.column("seq"), pa.array(out, pa.bool_())], names=[key, "ts", "seq", "accepted"])

    return dealt.select("k", "piece", "ts", "seq").mapInArrow(run, f"`{key}` {kind}, ts long, seq long, accepted boolean")
