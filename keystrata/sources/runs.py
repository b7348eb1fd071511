"""Sorted runs on disk, a folder for each level and number, and what is kept
beside them: key ranges, Bloom bits, a sparse summary and hash roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import integrity, pruning, sketches

SCHEMA = "base_key string, value_type string, value string, tombstone boolean, ts long, seq long, level long, gen long"


def write(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Each run's rows are sorted by key, so that the files' own statistics
    prune, and carry a Bloom filter on it."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    dealt = runs.select(*columns).repartitionByRange("level", "gen", "base_key").sortWithinPartitions("level", "gen", "base_key")
    dealt.write.mode(mode).option("parquet.bloom.filter.enabled#base_key", "true").partitionBy("level", "gen").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All runs; they are found by their folders, and filters on level and gen
    prune those."""
    return spark.read.schema(SCHEMA).parquet(path)


def sidecars(runs: DataFrame, config: Config) -> dict[str, DataFrame]:
    """What a reader may ask before it opens a run."""
    m, k = sketches.bloom_size(config.bloom_n, config.bloom_p)
    roots = integrity.merkle_root(runs, "base_key", "value", "level", "gen")
    return {"meta": pruning.run_meta(runs).join(roots, ["level", "gen"]), "bloom": pruning.run_bloom(runs, m, k), "summary": pruning.sparse_summary(runs, config.summary_step)}


PAGE_BITS = 32_768
BLOOM = "page long, bits binary"
SUMMARY = "i long, base_key string"
MERKLE = "depth int, i int, hash string"
SIDECARS = {"bloom": BLOOM, "summary": SUMMARY, "merkle": MERKLE}


def sidecars_of(run: DataFrame, bits: int, hashes: int, step: int) -> dict[str, DataFrame]:
    """What is stored beside one run: its Bloom bits in pages of PAGE_BITS, every
    ``step``-th key with its position, and its hash tree."""
    one = run.select(F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("gen"), "base_key", "value")
    at = F.col("bit").cast("long")
    found = sketches.bloom_bits(run, "base_key", bits, hashes).select(F.floor(at / PAGE_BITS).alias("page"), (at % PAGE_BITS).alias("at"))
    pages = found.groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    summary = pruning.sparse_summary(one, step).select("i", "base_key")
    return {"bloom": pages, "summary": summary.sortWithinPartitions("i"), "merkle": integrity.merkle_levels(one, "base_key", "value", "level", "gen").drop("level", "gen")}


def set_bits(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those rows of ``wanted`` (run, page, bit) whose bit is set in ``pages``."""
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return pages.join(wanted, ["run", "page"]).filter(F.getbit(byte, F.col("bit") % 8) == 1).select("run", "page", "bit")


def contents(runs: DataFrame) -> DataFrame:
    """The files of each run, as a table of contents lists them."""
    return runs.select("level", "gen", F.input_file_name().alias("file")).distinct()
