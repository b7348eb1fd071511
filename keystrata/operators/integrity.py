"""Checksums of records and hash trees over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import little_endian
from ..sources.scratch import kept
from .ranking import positioned

FOLD = 10  # levels folded at once
_UP = "transform(sequence(0, (size(a) + 1) div 2 - 1), i -> unhex(sha1(concat(a[2 * i], coalesce(get(a, 2 * i + 1), unhex(repeat('00', 20)))))))"


def record_body(k: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    """The bytes a record's checksum covers: time, deletion mark, sizes, key, value."""
    key, val = k.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(little_endian(ts, 8), little_endian(tombstone.cast("int"), 1), little_endian(F.length(key), 8), little_endian(F.length(val), 8), key, val)


def record_crc(k: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    return F.crc32(record_body(k, value, tombstone, ts))


def merkle_root(rows: DataFrame, order: str, value: str, *within: str) -> DataFrame:
    """The root over SHA-1 of the values, in key order, of each group.

    An odd node at a level's end is paired with twenty zero bytes. Rows are
    folded in blocks of 2^FOLD neighbours, a shuffle for each FOLD levels, so
    no task gathers a whole run.
    """
    sizes = rows.groupBy(*within).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n")).first()[0] or 0
    leaves = rows.select(*within, order, F.unhex(F.sha1(F.col(value).cast("binary"))).alias("h"))
    nodes = positioned(leaves, order, *within).join(sizes, list(within)).select(*within, "i", "n", "h")
    most = 1
    while True:
        block = F.floor(F.col("i") / 2**FOLD)
        folded = nodes.groupBy(*within, block.alias("i"), "n").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("at"), "h"))).alias("all"))
        folded = folded.withColumn("a", F.expr("transform(all, x -> x.h)")).withColumn("up", F.least(F.lit(FOLD), F.ceil(F.log2("n"))).cast("int"))
        folded = folded.withColumn("a", F.expr(f"CASE WHEN up = 0 THEN a ELSE aggregate(sequence(1, up), a, (a, l) -> {_UP}) END"))
        nodes = folded.select(*within, "i", F.ceil(F.col("n") / 2**FOLD).alias("n"), F.col("a")[0].alias("h"))
        most *= 2**FOLD
        if most >= top:
            return nodes.select(*within, F.lower(F.hex("h")).alias("root"))


def merkle_levels(rows: DataFrame, order: str, value: str, *within: str) -> DataFrame:
    """All nodes of each group's tree from the root down, paddings included:
    depth, i, hash. Each level is made from the one below by joining
    neighbours two by two, a shuffle a level, so no row or task holds a run."""
    sizes = rows.groupBy(*within).agg(F.count("*").alias("n"))
    leaves = rows.select(*within, order, F.unhex(F.sha1(F.col(value).cast("binary"))).alias("h"))
    nodes = kept(positioned(leaves, order, *within).join(sizes, list(within)).select(*within, "i", "n", F.lit(0).alias("up"), "h"))
    found, top = nodes, nodes.agg(F.max("n")).first()[0] or 0
    empty = F.unhex(F.lit("00" * 20))
    while top > 1:
        half = F.floor(F.col("i") / 2)
        pair = nodes.filter("n > 1").groupBy(*within, half.alias("i"), "n", "up").agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("b"))
        nodes = kept(pair.select(*within, "i", F.ceil(F.col("n") / 2).alias("n"), (F.col("up") + 1).alias("up"), F.unhex(F.sha1(F.concat("a", F.coalesce("b", empty)))).alias("h")))
        found = found.unionByName(nodes)
        top = -(-top // 2)
    height = sizes.select(*within, F.ceil(F.log2("n")).cast("int").alias("height"))
    padding = found.filter("n > 1 AND n % 2 = 1 AND i = n - 1").withColumn("i", F.col("i") + 1).withColumn("h", empty)
    every = found.unionByName(padding).join(height, list(within))
    return every.select(*within, (F.col("height") - F.col("up")).cast("int").alias("depth"), F.col("i").cast("int").alias("i"), F.lower(F.hex("h")).alias("hash"))
