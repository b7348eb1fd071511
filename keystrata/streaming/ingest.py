"""A stream of operations into level-0 runs, one for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import latest
from ..sources import runs as run_files


def into_runs(ops: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """ops: a streaming DataFrame of versions. The batch number names the run,
    and a batch that is repeated replaces its own run: each takes effect once."""

    def write(batch: DataFrame, number: int) -> None:
        run = latest(batch).withColumn("level", F.lit(0).cast("long")).withColumn("gen", F.lit(number).cast("long"))
        columns = [x.split()[0] for x in run_files.SCHEMA.split(", ")]
        ordered = run.select(*columns).drop("level", "gen").sortWithinPartitions("base_key")
        ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#base_key", "true").parquet(f"{path}/level=0/gen={number}")

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
