"""Keys: the base key, the type named by a suffix, and what a key may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKETCHES = ("hll", "cms", "bloom", "simHash")

#: What a listing shows in place of a sketch's bytes.
LABELS = {"bloom": "Bloom filter", "cms": "Count min sketch", "hll": "Hyper Log Log", "simHash": "Sim Hash"}


def base_key(k: Column) -> Column:
    return F.split_part(k, F.lit("-"), F.lit(1))


def value_type(k: Column) -> Column:
    kind = F.lit("string")
    for s in SKETCHES:
        kind = F.when(F.endswith(k, F.lit(f"-{s}")), s).otherwise(kind)
    return kind


def typed_key(key: Column, kind: Column) -> Column:
    return F.when(kind == "string", key).otherwise(F.concat(key, F.lit("-"), kind))


def valid_key(k: Column) -> Column:
    """A key that PUT takes: not blank and without a hyphen."""
    return F.coalesce(~F.contains(k, F.lit("-")) & (F.trim(k) != ""), F.lit(False))


def valid_value(v: Column) -> Column:
    return F.coalesce(v != "", F.lit(False))


def display(kind: Column, value: Column) -> Column:
    shown = value.cast("string")
    for s, label in LABELS.items():
        shown = F.when(kind == s, label).otherwise(shown)
    return shown
