"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TASK_ROWS, SPLITTERS = 2_000_000, 255


def positioned(rows: DataFrame, order: str, *within: str, name: str = "i", task_rows: int | None = None) -> DataFrame:
    """``rows`` with each one's position, from 0, by ``order`` in its group.

    While no group has over ``task_rows`` rows, a group is one task's. Beyond
    that its keys are cut at splitters, the keys of smallest hash, and what
    lies before a cut is counted: a group is then spread over many tasks.
    """
    top = rows.groupBy(*within).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if top <= (TASK_ROWS if task_rows is None else task_rows):
        place = F.row_number().over(Window.partitionBy(*within).orderBy(order)) - 1
        return rows.withColumn(name, place.cast("long"))
    keys = rows.select(order).distinct().withColumn("__h", F.xxhash64(order)).orderBy("__h", order).limit(SPLITTERS)
    kind = rows.schema[order].dataType
    cuts = F.array(*((F.struct(*map(F.lit, r[0])) if isinstance(r[0], tuple) else F.lit(r[0])).cast(kind) for r in sorted(keys.select(order).collect(), key=lambda r: str(r[0]).encode())))
    cut = rows.withColumn("__part", F.size(F.filter(cuts, lambda c: c <= F.col(order))))
    sizes = cut.groupBy(*within, "__part").agg(F.count("*").alias("__n"))  # SPLITTERS + 1 rows a group at most
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*within, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(order)) - 1
    return cut.join(base, [*within, "__part"]).withColumn(name, F.col("__base") + own).drop("__part", "__base")
