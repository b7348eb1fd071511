"""The byte format of log records, little-endian: crc u32, time u64, deletion
mark u8, key size u64, value size u64, key, value."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import little_endian
from ..operators.integrity import record_body, record_crc

HEAD = struct.Struct("<IQBQQ")
FIELDS = "segment string, i long, k string, value binary, tombstone boolean, ts long, valid boolean"


def encoded(k: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    """A record's bytes."""
    return F.concat(little_endian(record_crc(k, value, tombstone, ts), 4), record_body(k, value, tombstone, ts))


def number(data: Column, at: int, size: int) -> Column:
    """The little-endian number in ``size`` bytes from byte ``at`` on, from 0;
    eight bytes hold numbers below 2^63."""
    turned = F.concat(*(F.substring(F.hex(data), 2 * (at + k) + 1, 2) for k in reversed(range(size))))
    return F.conv(turned, 16, 10).cast("long")


def fields(data: Column) -> Column:
    """k, value, tombstone, ts and valid of a column that holds one record each."""
    rest = F.substring(data, HEAD.size + 1, 2**30)
    key_size = number(data, 13, 8).cast("int")
    return F.struct(
        F.decode(F.substring(rest, F.lit(1), key_size), "utf-8").alias("k"), F.substring(rest, key_size + 1, number(data, 21, 8).cast("int")).alias("value"),
        (number(data, 12, 1) == 1).alias("tombstone"), number(data, 4, 8).alias("ts"), (F.crc32(F.substring(data, 5, 2**30)) == number(data, 0, 4)).alias("valid"),
    )


def decode(data: bytes) -> list[tuple[str, bytes, bool, int, bool]]:
    """Key, value, deletion mark, time and whether the checksum holds, of each
    record; what breaks off at the end is left out."""
    out, at = [], 0
    while at + HEAD.size <= len(data):
        crc, ts, dead, key_size, value_size = HEAD.unpack_from(data, at)
        end = at + HEAD.size + key_size + value_size
        if end > len(data):
            break
        key = at + HEAD.size
        out.append((data[key : key + key_size].decode("utf-8", "replace"), data[key + key_size : end], bool(dead), ts, zlib.crc32(data[at + 4 : end]) == crc))
        at = end
    return out


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the segment files below ``path``, a task for each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("segment"), "content")

    def run(batches):
        for batch in batches:
            for segment, data in zip(batch.column("segment").to_pylist(), batch.column("content"), strict=True):
                rows = [(segment, i, *r) for i, r in enumerate(decode(data.as_py()))]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FIELDS.split(", ")])

    return files.mapInArrow(run, FIELDS)
