"""HyperLogLog, count-min, Bloom and SimHash as rows of DataFrames.

Sketches of parts are merged as the whole is built: registers by max, cells by
sum, bits by distinct.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hashing import seed_hex, seeded, trailing_zeros


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits m and hashes k for n elements at false-positive rate p."""
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Columns and rows for error epsilon with probability 1 - delta."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def size_columns(n: Column, p: Column, epsilon: Column, delta: Column) -> list[Column]:
    """The same sizes as columns m, k, cms_m and cms_k."""
    m = F.ceil(n * F.abs(F.ln(p)) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0)))
    return [
        m.cast("long").alias("m"), F.ceil(m / n * F.ln(F.lit(2.0))).cast("long").alias("k"),
        F.ceil(F.e() / epsilon).cast("long").alias("cms_m"), F.ceil(F.ln(F.e() / delta)).cast("long").alias("cms_k"),
    ]


def _hashed(items: DataFrame, item: str, modulus: int, k: int, *keep: str) -> DataFrame:
    """A row for each item and hash: ``keep``, item, r and j."""
    each = F.posexplode(F.array(*(seeded(F.col(item), i, modulus) for i in range(1, k + 1)))).alias("r", "j")
    return items.select(*keep, item, each)


# ---- Bloom


def positions(items: DataFrame, item: str, m: int, k: int, *keep: str) -> DataFrame:
    return _hashed(items.select(*keep, item).distinct(), item, m, k, *keep).select(*keep, item, F.col("j").alias("bit"))


def positions_of(item: str, m: int, k: int) -> list[int]:
    """The same positions of one item, worked out here."""
    return [int(hashlib.md5(item.encode() + bytes.fromhex(seed_hex(i))).hexdigest()[:16], 16) % m for i in range(1, k + 1)]


def bloom_bits(items: DataFrame, item: str, m: int, k: int, *within: str) -> DataFrame:
    """The set bits, at most m for each group of ``within``."""
    return positions(items, item, m, k, *within).select(*within, "bit").distinct()


def bloom_probe(probes: DataFrame, item: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Each distinct probe and whether all its bits are set."""
    found = positions(probes, item, m, k).join(F.broadcast(bits.withColumn("set", F.lit(1))), "bit", "left")  # m rows at most
    return found.groupBy(item).agg((F.count("*") == F.count("set")).alias("may_contain"))


# ---- count-min


def cms_cells(items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """Cells r, j, c; each distinct item is hashed once, after counting."""
    counted = items.groupBy(item).agg(F.count("*").alias("n"))
    return _hashed(counted, item, m, k, "n").groupBy("r", "j").agg(F.sum("n").alias("c"))


def cms_query(probes: DataFrame, item: str, cells: DataFrame, m: int, k: int) -> DataFrame:
    """Each distinct probe's estimated count; cells that were never hit count 0."""
    asked = _hashed(probes.select(item).distinct(), item, m, k)
    found = asked.join(F.broadcast(cells), ["r", "j"], "left")  # m * k rows at most
    return found.groupBy(item).agg(F.min(F.coalesce("c", F.lit(0))).cast("long").alias("estimate"))


# ---- HyperLogLog


def hll_place(item: Column, p: int) -> tuple[Column, Column]:
    """Bucket and rank of an item's text hash: the 256 bits of a hex MD5's
    characters, bucket by the first p of them, rank by the zeros at the end."""
    x = F.md5(item.cast("string").cast("binary"))
    bits = F.lit(0)
    for i in range((p + 7) // 8):
        bits = bits * 256 + F.ascii(F.substring(x, i + 1, 1))
    return F.shiftright(bits, -p % 8).cast("int"), trailing_zeros(F.ascii(F.substring(x, 32, 1)))


def hll_registers(items: DataFrame, item: str, p: int) -> DataFrame:
    """bucket and rank, the greatest of its items."""
    bucket, rank = hll_place(F.col(item), p)
    return items.select(bucket.alias("bucket"), rank.alias("rank")).groupBy("bucket").agg(F.max("rank").cast("int").alias("rank"))


def hll_estimate(registers: DataFrame, p: int, *within: str) -> DataFrame:
    """The estimate, a row for each group of ``within``, with the corrections
    for small and large counts."""
    m = float(2**p)
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.groupBy(*within).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count_if(F.col("rank") > 0).alias("filled"), F.count("*").alias("seen"))
    empty = F.lit(m) - F.col("filled")
    raw = F.lit(alpha * m * m) / (F.col("s") + (F.lit(m) - F.col("seen")))
    two32 = float(2**32)
    estimate = F.when((raw <= 2.5 * m) & (empty > 0), m * F.ln(F.lit(m) / empty)).when(raw > two32 / 30, -two32 * F.ln(1 - raw / two32)).otherwise(raw)
    return sums.select(*within, estimate.alias("estimate"))


def hll_native(items: DataFrame, item: str, p: int = 12) -> DataFrame:
    """The engine's own sketch, for real use."""
    return items.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(item).cast("string"), F.lit(p))).alias("estimate"))


# ---- SimHash


def _signs(texts: pd.Series) -> pd.Series:
    place: dict[str, int] = {}
    rows = np.empty((4096, 256), np.int8)

    def places(words: list[str]) -> list[int]:
        nonlocal rows
        if len(place) > 50_000:
            place.clear()
        new = [w for w in words if w not in place]
        if new:
            while len(place) + len(new) > len(rows):
                rows = np.concatenate((rows, np.empty_like(rows)))
            digests = b"".join(hashlib.md5(w.encode()).hexdigest().encode() for w in new)
            rows[len(place) : len(place) + len(new)] = 2 * np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 256).astype(np.int8) - 1
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        return [place[w] for w in words]

    def one(text: str) -> str:
        counts = Counter(text.split(" "))
        total = np.zeros(256)
        words, times = list(counts), np.array(list(counts.values()), np.float64)
        for k in range(0, len(words), 4096):  # sums of whole numbers, exact in doubles
            total += times[k : k + 4096] @ rows_of(words[k : k + 4096])
        return ((total >= 0).astype(np.uint8) + ord("0")).tobytes().decode()

    def rows_of(words: list[str]) -> np.ndarray:
        at = places(words)
        return rows[at].astype(np.float64)

    return texts.map(one)


def simhash(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``bits``: words between single blanks, in lower case,
    weighed by their count; 256 signs, a tie counting as 1."""
    return texts.withColumn("bits", F.pandas_udf(_signs, StringType())(F.lower(F.coalesce(F.col(text), F.lit("")))))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 256-character strings; -1 where one is missing."""
    words = range(1, 257, 32)
    one = lambda x, k: F.conv(F.substring(x, k, 32), 2, 10).cast("long")
    return F.coalesce(sum((F.bit_count(one(a, k).bitwiseXOR(one(b, k))) for k in words), start=F.lit(0)), F.lit(-1)).cast("long")
