"""Sketches that are the values of keys: built, written as text, read back,
merged and asked, for any number of keys at once.

A sketch is a set of cells (cell, n): registers of a HyperLogLog by bucket,
counters of a count-min sketch by row * columns + column, bits of a Bloom
filter. As a value it is the text ``cell:n,cell:n,...`` in the order of the
cells; cells that no item met are left out. Sketches of two batches merge to
that of both: registers and bits by max, counters by sum. A SimHash value
holds named fingerprints, ``name=hex;name=hex;...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import seeded
from . import sketches


def sizes(kind: str, config: Config) -> tuple[int, int]:
    """Columns (or bits, or registers) and hashes of a kind."""
    if kind == "hll":
        return 2**config.hll_p, 1
    return sketches.bloom_size(config.bloom_n, config.bloom_p) if kind == "bloom" else sketches.cms_size(config.cms_epsilon, config.cms_delta)


def cells(items: DataFrame, kind: str, config: Config) -> DataFrame:
    """base_key, cell and n of the items (base_key, item) of each key; equal
    items of a key are hashed once."""
    m, k = sizes(kind, config)
    counted = items.groupBy("base_key", F.col("item").cast("string").alias("item")).agg(F.count("*").alias("times"))
    if kind == "hll":
        bucket, rank = sketches.hll_place(F.col("item"), config.hll_p)
        each = counted.select("base_key", bucket.cast("long").alias("cell"), rank.cast("long").alias("n"))
    else:
        hashes = F.posexplode(F.array(*(seeded(F.col("item"), i, m) for i in range(1, k + 1)))).alias("r", "j")
        each = counted.select("base_key", "times", hashes)
        each = each.select("base_key", F.col("j").cast("long").alias("cell"), F.lit(1).cast("long").alias("n")) if kind == "bloom" else each.select("base_key", (F.col("r").cast("long") * m + F.col("j")).alias("cell"), F.col("times").alias("n"))
    return merged(each, kind)


def merged(some: DataFrame, kind: str) -> DataFrame:
    """The cells of the union of what the given cells are sketches of."""
    n = F.sum("n") if kind == "cms" else F.max("n")
    return some.groupBy("base_key", "cell").agg(n.cast("long").alias("n"))


def written(some: DataFrame) -> DataFrame:
    """base_key and value, the text of a key's cells; a sketch has a fixed
    number of cells, so a row is of bounded size."""
    held = F.array_sort(F.collect_list(F.struct("cell", "n")))
    text = F.array_join(F.transform(held, lambda x: F.concat(x["cell"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return some.groupBy("base_key").agg(text.alias("value"))


def read(values: DataFrame) -> DataFrame:
    """The cells of written sketches (base_key, value)."""
    pairs = values.filter(F.col("value") != "").select("base_key", F.explode(F.split("value", ",")).alias("x"))
    part = lambda i: F.split_part("x", F.lit(":"), F.lit(i)).cast("long")
    return pairs.select("base_key", part(1).alias("cell"), part(2).alias("n"))


def updated(values: DataFrame, items: DataFrame, kind: str, config: Config) -> DataFrame:
    """The written sketches after further items; keys without one get theirs."""
    return written(merged(read(values).unionByName(cells(items, kind, config)), kind))


def estimates(values: DataFrame, config: Config) -> DataFrame:
    """base_key and estimate: how many distinct items each HyperLogLog saw."""
    return sketches.hll_estimate(read(values).select("base_key", F.col("n").alias("rank")), config.hll_p, "base_key")


def counts(values: DataFrame, probes: DataFrame, config: Config) -> DataFrame:
    """base_key, item and estimate of the distinct probes (base_key, item) in
    their key's count-min sketch; keys without a sketch are left out."""
    m, k = sizes("cms", config)
    asked = _asked(values, probes, m, k).withColumn("cell", F.col("r").cast("long") * m + F.col("j"))
    found = asked.join(read(values), ["base_key", "cell"], "left")
    return found.groupBy("base_key", "item").agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("estimate"))


def members(values: DataFrame, probes: DataFrame, config: Config) -> DataFrame:
    """base_key, item and may_contain of the distinct probes in their key's filter."""
    asked = _asked(values, probes, *sizes("bloom", config)).withColumn("cell", F.col("j").cast("long"))
    found = asked.join(read(values), ["base_key", "cell"], "left")
    return found.groupBy("base_key", "item").agg((F.count("*") == F.count("n")).alias("may_contain"))


def _asked(values: DataFrame, probes: DataFrame, m: int, k: int) -> DataFrame:
    distinct = probes.select("base_key", F.col("item").cast("string").alias("item")).distinct().join(values.select("base_key"), "base_key", "left_semi")
    return distinct.select("base_key", "item", F.posexplode(F.array(*(seeded(F.col("item"), i, m) for i in range(1, k + 1)))).alias("r", "j"))


# ---- SimHash


def _hex(bits: Column) -> Column:
    words = [F.lpad(F.conv(F.substring(bits, k, 32), 2, 16), 8, "0") for k in range(1, 257, 32)]
    return F.lower(F.concat(*words))


def fingerprints(texts: DataFrame) -> DataFrame:
    """base_key, name and hex (64 digits) of named texts (base_key, name,
    text). Names hold neither = nor ; (such rows are left out)."""
    good = texts.filter(~F.contains("name", F.lit("=")) & ~F.contains("name", F.lit(";")))
    return sketches.simhash(good, "text").select("base_key", F.col("name").cast("string").alias("name"), _hex(F.col("bits")).alias("hex"))


def written_prints(prints: DataFrame) -> DataFrame:
    """base_key and value, a key's prints in the order of their names; of equal
    names the greatest print stands."""
    one = prints.groupBy("base_key", "name").agg(F.max("hex").alias("hex"))
    held = F.array_sort(F.collect_list(F.struct("name", "hex")))
    return one.groupBy("base_key").agg(F.array_join(F.transform(held, lambda x: F.concat(x["name"], F.lit("="), x["hex"])), ";").alias("value"))


def read_prints(values: DataFrame) -> DataFrame:
    pairs = values.filter(F.col("value") != "").select("base_key", F.explode(F.split("value", ";")).alias("x"))
    return pairs.select("base_key", F.split_part("x", F.lit("="), F.lit(1)).alias("name"), F.split_part("x", F.lit("="), F.lit(2)).alias("hex"))


def updated_prints(values: DataFrame, texts: DataFrame) -> DataFrame:
    """The values after further texts; a name that comes again is replaced."""
    new = fingerprints(texts)
    old = read_prints(values).join(new.select("base_key", "name"), ["base_key", "name"], "left_anti")
    return written_prints(old.unionByName(new))


def distances(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """base_key, a, b and distance of pairs of names (base_key, a, b): bits in
    which their prints differ, -1 where one is unknown."""
    prints = read_prints(values)
    first = prints.select("base_key", F.col("name").alias("a"), F.col("hex").alias("x"))
    second = prints.select("base_key", F.col("name").alias("b"), F.col("hex").alias("y"))
    word = lambda c, k: F.conv(F.substring(c, k, 8), 16, 10).cast("long")
    apart = sum((F.bit_count(word(F.col("x"), k).bitwiseXOR(word(F.col("y"), k))) for k in range(1, 65, 8)), start=F.lit(0))
    met = pairs.join(first, ["base_key", "a"], "left").join(second, ["base_key", "b"], "left")
    return met.select("base_key", "a", "b", F.coalesce(apart, F.lit(-1)).cast("long").alias("distance"))
