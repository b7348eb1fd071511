"""Packing by power-of-two decomposition.

Each document's ids (with an end id) are cut into pieces of binary lengths:
as many of the full length as fit, then one piece for each set bit of the
rest, longest first. Pieces of equal length share a bucket, and each piece is
a sequence of its bucket's length: nothing is padded and no sequence crosses
documents. A piece never leaves the task that read its document, so there is
no shuffle; ``write_buckets`` lays the buckets out as folders, and
``read_buckets`` reads all or those of some lengths, others unopened.

Cases: a null text counts as empty and yields one piece with the end id; a
text of any length is cut whole; rows that share a doc_id, or have none, are
packed as separate documents; an empty table yields no pieces; other columns
are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_folder, text_slices, whole_texts
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def lengths(n: int, full: int = 1024) -> list[int]:
    """The piece lengths of n ids: multiples of ``full``, then the bits of the rest."""
    bits = n % full
    return [full] * (n // full) + [1 << b for b in range(bits.bit_length() - 1, -1, -1) if bits >> b & 1]


STORED = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"


def pieces(docs: DataFrame, tokenizer: str, keep_space: bool = True, end_id: int = 0, full: int = 1024) -> DataFrame:
    """STORED rows, one per piece; ids are little-endian unsigned 32-bit
    numbers. ``full`` is a power of two. sequence_id holds the bucket's bit,
    the task and a count, so it is unique and a repeated task gives the same
    one."""
    if full & (full - 1):
        raise ValueError("the full length must be a power of two")
    end = np.asarray([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in STORED.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches):
            docs, totals, starts, sizes, held = [], [], [], [], []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer, keep_space).encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                at = 0
                for size in lengths(n, full):
                    docs.append(doc)
                    totals.append(n)
                    starts.append(at)
                    sizes.append(size)
                    held.append(ids[4 * at : 4 * (at + size)])
                    at += size
            bucket = np.array(sizes, np.int64)
            sequence = np.log2(bucket).astype(np.int64) << 58 | task << 34 | np.arange(made, made + len(sizes))
            made += len(sizes)
            columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(sequence), pa.array(np.zeros(len(sizes), np.int64)), pa.array(bucket.astype(np.int32)), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole_texts(docs).mapInArrow(run, STORED)


def digests(stored: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per piece, its length and CRC-32 taken from its ids; bucket is the
    sequence's length."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            own = {"length": pa.array(sizes), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                own["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names=names)

    return stored.select(*[x.split()[0] for x in STORED.split(", ")]).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, keep_space: bool = True, end_id: int = 0, full: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece, straight from the documents."""
    return digests(pieces(docs, tokenizer, keep_space, end_id, full), with_ids)


def write_buckets(stored: DataFrame, path: str) -> None:
    """The rows of ``pieces``, a folder for each length."""
    stored.withColumn("sequence_length", F.col("bucket")).write.option("compression", "zstd").partitionBy("sequence_length").parquet(path)


def read_buckets(spark: SparkSession, path: str, sequence_lengths: list[int] | None = None) -> DataFrame:
    """Stored pieces; lengths that are not asked for are not opened."""
    stored = spark.read.schema(STORED + ", sequence_length int").parquet(path)
    return stored if sequence_lengths is None else stored.filter(F.col("sequence_length").isin(sequence_lengths))


def packed(docs: DataFrame, tokenizer: str, keep_space: bool = True, end_id: int = 0, full: int = 1024) -> DataFrame:
    """The pieces of ``docs``, laid out by bucket in the shared folder and read
    back: a row for each, its length and CRC-32 taken from the stored ids."""
    path = shared_folder(docs.sparkSession)
    write_buckets(pieces(docs, tokenizer, keep_space, end_id, full), path)
    return digests(read_buckets(docs.sparkSession, path))
