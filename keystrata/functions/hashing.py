"""Seeded hashes, bits and the little-endian bytes of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_hex(i: int) -> str:
    """A seed of 32 bytes: the number in the first four, then zeros. Seeds
    count from 1, so that sketches are alike from run to run."""
    return f"{i:08x}" + "00" * 28


def seeded(x: Column, i: int, modulus: int) -> Column:
    """The first 64 bits of MD5(x, seed i), modulo ``modulus``, as an int."""
    digest = F.md5(F.concat(x.cast("binary"), F.unhex(F.lit(seed_hex(i)))))
    whole = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(whole, F.lit(modulus).cast("decimal(20,0)")).cast("int")


def little_endian(x: Column, size: int) -> Column:
    """A nonnegative number as ``size`` bytes, lowest first: its bytes change
    places as a number, which is then written out once."""
    x = x.cast("long")
    turned = F.lit(0).cast("long")
    for k in range(size):
        byte = F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255).cast("long"))
        turned = turned.bitwiseOR(F.shiftleft(byte, 8 * (size - 1 - k)))
    return F.unhex(F.lpad(F.hex(turned), 2 * size, "0"))


def trailing_zeros(x: Column, most: int = 8) -> Column:
    """Zero bits below the lowest one; ``most`` for 0."""
    found = F.lit(most)
    for k in reversed(range(most)):
        found = F.when(x.bitwiseAND(F.lit((1 << (k + 1)) - 1)) == (1 << k), k).otherwise(found)
    return found
