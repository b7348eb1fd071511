"""What lets a read skip a run: key ranges, sparse and dense indexes, Bloom bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .ranking import positioned


def run_meta(runs: DataFrame) -> DataFrame:
    """Rows, least and greatest key of each run."""
    return runs.groupBy("level", "gen").agg(F.count("*").alias("n"), F.min("base_key").alias("lo"), F.max("base_key").alias("hi"))


def overlaps(meta: DataFrame) -> DataFrame:
    """level, gen, met and neighbour of each run: how many runs of its level
    meet its key range, and the one of them that begins next (null: none).

    Runs that meet are all but those that end before or begin after, which
    are counted by the positions of the ends in order; no pair is made.
    """
    ends = meta.select("level", F.col("lo").alias("at"), F.lit(0).alias("kind"), "gen", "hi").union(meta.select("level", F.col("hi").alias("at"), F.lit(1).alias("kind"), "gen", "hi"))
    place = positioned(ends.withColumn("o", F.struct("at", "kind", "gen")), "o", "level")
    opens, closes = place.filter("kind = 0"), place.filter("kind = 1")
    # before a run's begin stand the begins of rank(begin) runs; what of them has closed already does not meet it
    begin = positioned(opens.select("level", "gen", "o", F.col("i").alias("at_open")), "o", "level", name="opened").select("level", "gen", "at_open", "opened")
    close = positioned(closes.select("level", "gen", "o", F.col("i").alias("at_close")), "o", "level", name="closed").select("level", "gen", "at_close", "closed")
    total = meta.groupBy("level").agg(F.count("*").alias("n"))
    both = begin.join(close, ["level", "gen"]).join(total, "level")
    ended_before = F.col("at_open") - F.col("opened")  # ends in front of this begin
    begun_by_end = F.col("at_close") - F.col("closed")  # begins in front of this end
    begins_after = F.col("n") - begun_by_end
    nexts = begin.select("level", (F.col("opened") - 1).alias("opened"), F.col("gen").alias("neighbour"), F.col("at_open").alias("next_open"))
    found = both.join(nexts, ["level", "opened"], "left")
    meets = F.col("next_open") < F.col("at_close")
    return found.select("level", "gen", (F.col("n") - ended_before - begins_after - 1).alias("met"), F.when(meets, F.col("neighbour")).alias("neighbour"))


def dense_index(runs: DataFrame) -> DataFrame:
    """Each key's position in its run."""
    return positioned(runs.select("level", "gen", "base_key"), "base_key", "level", "gen")


def sparse_summary(runs: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th key of a run."""
    return dense_index(runs).filter(F.col("i") % step == 0)


def floor_key(summary: DataFrame, key: str) -> DataFrame:
    """level, gen, i and sampled: in each run the greatest sampled key at or
    below ``key``, from which its search starts; runs that begin after it are
    left out."""
    below = summary.filter(F.col("base_key") <= key).groupBy("level", "gen").agg(F.max(F.struct("base_key", "i")).alias("s"))
    return below.select("level", "gen", F.col("s.i").alias("i"), F.col("s.base_key").alias("sampled"))


def lookup(index: DataFrame, summary: DataFrame, key: str, step: int) -> DataFrame:
    """level, gen and i of ``key`` in the runs that hold it: of each run only
    the ``step`` entries from its sampled key on are compared."""
    starts = floor_key(summary, key).select("level", "gen", F.col("i").alias("start"))
    near = index.join(starts, ["level", "gen"]).filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + step))
    return near.filter(F.col("base_key") == key).select("level", "gen", "i")


def at_positions(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """level, gen, i and base_key of the entries at wanted positions (level, gen, i)."""
    return index.join(wanted.select("level", "gen", "i").distinct(), ["level", "gen", "i"]).select("level", "gen", "i", "base_key")


def run_bloom(runs: DataFrame, m: int, k: int) -> DataFrame:
    """The set bits of each run's Bloom filter."""
    return sketches.bloom_bits(runs, "base_key", m, k, "level", "gen")


def candidate_runs(runs: DataFrame, meta: DataFrame, bits: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """The runs that may hold a key: in its range, and with all its bits set."""
    probe = runs.sparkSession.range(1).select(F.lit(key).alias("base_key"))
    wanted = sketches.positions(probe, "base_key", m, k).select("bit").distinct()
    hits = bits.join(F.broadcast(wanted), "bit").groupBy("level", "gen").agg(F.count("*").alias("hits"))  # k rows at most
    need = wanted.agg(F.count("*").alias("need"))
    full = hits.join(F.broadcast(need), hits["hits"] == need["need"]).select("level", "gen")
    return meta.filter((F.col("lo") <= key) & (F.col("hi") >= key)).join(full, ["level", "gen"], "left_semi").select("level", "gen")
