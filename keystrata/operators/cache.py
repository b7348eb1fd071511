"""The hits of a least-recently-used cache over a log of accesses."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .ranking import positioned


def lru_hits(accesses: DataFrame, size: int, block_rows: int = 4096) -> DataFrame:
    """seq, base_key and hit of every access, by ascending seq.

    The log is cut into blocks of seq. What a cache holds where a block begins
    are the ``size`` keys last used before it, which most often the block
    before decides alone; blocks with fewer distinct keys look further back,
    twice as far each round. Then all blocks are replayed side by side.
    """
    log = accesses.select("seq", "base_key").withColumn("block", F.floor(F.col("seq") / block_rows))
    newest = Window.partitionBy("block").orderBy(F.desc("seq"))

    def top(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("block", "base_key").agg(F.max("seq").alias("seq"))
        return last.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= size).drop("r")

    numbered = kept(positioned(log.select("block").distinct(), "block", name="number"))  # a row per block
    held = kept(top(log).join(numbered, "block").select(F.col("number").alias("block"), "base_key", "seq"))
    count = numbered.count()
    reach = 1
    while reach < count and held.groupBy("block").agg(F.count("*").alias("n")).filter((F.col("n") < size) & (F.col("block") >= reach)).limit(1).count():
        held = kept(top(held.union(held.withColumn("block", F.col("block") + reach).filter(F.col("block") < count))))
        reach *= 2
    # the state before a block is what the block before it leaves
    before = held.withColumn("block", F.col("block") + 1).filter(F.col("block") < count).withColumn("warm", F.lit(True))
    own = log.join(numbered, "block").select(F.col("number").alias("block"), "base_key", "seq").withColumn("warm", F.lit(False))
    dealt = before.select("block", "base_key", "seq", "warm").unionByName(own).repartition("block").sortWithinPartitions("block", "seq")

    def replay(batches):
        block, cache = None, OrderedDict()
        for batch in batches:
            out = []
            for b, key, seq, warm in zip(*(batch.column(c).to_pylist() for c in ("block", "base_key", "seq", "warm")), strict=True):
                if b != block:
                    block, cache = b, OrderedDict()
                hit = key in cache
                cache[key] = None
                cache.move_to_end(key)
                if len(cache) > size:
                    cache.popitem(last=False)
                if not warm:
                    out.append((seq, key, hit))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_())], names=["seq", "base_key", "hit"])

    return dealt.mapInArrow(replay, "seq long, base_key string, hit boolean")


class Recent:
    """The last ``size`` keys used, with their values, the latest kept longest."""

    def __init__(self, size: int):
        self.size, self.held = size, OrderedDict()

    def __contains__(self, key: str) -> bool:
        return key in self.held

    def get(self, key: str):
        return self.held.get(key)  # looking does not count as use

    def add(self, key: str, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        if len(self.held) > self.size:
            self.held.popitem(last=False)

    def drop(self, key: str) -> None:
        self.held.pop(key, None)
