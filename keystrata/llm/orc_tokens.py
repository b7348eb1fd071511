"""Token-id output as ORC.

Documents are encoded whole, an end id is appended, and the ids go to ORC
files in ascending doc_id order: integer run-length encoding for the id lists,
a row index per ``row_index_stride`` rows and a Bloom filter on doc_id, so a
reader takes stripes in parallel and skips those that cannot hold an id.

Beside the files, a small table holds the number of ids in each, so that a
read of a few documents opens no other file to know where they start.

Cases: a null text counts as empty and yields the end id alone; a text of any
length is one row, encoded whole; rows with a
null doc_id come first; rows that share a doc_id stay separate rows, ordered
by their text's hash; an empty table writes no rows; other columns are left
out. Rows are dealt by ranges of (doc_id, hash), so no key fills one task.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import text_slices, whole_texts
from .tokens import encoder

STORED = "part int, local_start long, doc_id long, n_tokens long, ids array<int>"


def encoded_in_order(docs: DataFrame, tokenizer: str, keep_space: bool, end_id: int) -> DataFrame:
    """STORED rows, sorted; local_start counts the ids before a row in its
    partition, which is ``part``."""
    tie = F.xxhash64("text")
    ordered = whole_texts(docs).repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches):
            ids = [x + end for x in encoder(tokenizer, keep_space).encode(batch.column("text").to_pylist())]
            counts = [len(x) // 4 for x in ids]
            starts = list(accumulate(counts, initial=before))
            before = starts.pop()
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            columns = [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "local_start", "doc_id", "n_tokens", "ids"])

    return ordered.mapInArrow(run, STORED)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, keep_space: bool = False, end_id: int = 2, stripe_bytes: int = 64 << 20, row_index_stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Write the token files of ``docs`` below ``path``."""
    options = {
        "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(row_index_stride), "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp), "compression": "zstd",
    }
    spark = docs.sparkSession
    encoded_in_order(docs, tokenizer, keep_space, end_id).write.options(**options).orc(f"{path}/tokens")
    stored = spark.read.schema(STORED).orc(f"{path}/tokens")
    # one row of two numbers per file; the widest thing here that a single task sees
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.orc(f"{path}/starts")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, first: int | None = None, last: int | None = None, broadcast_files: int = 500_000) -> DataFrame:
    """Stored rows with ``start``, the ids of all documents before each one.
    A list or a range of ids reaches the ORC reader, which prunes stripes and
    row groups by their statistics and Bloom filters."""
    stored = spark.read.schema(STORED).orc(f"{path}/tokens")
    base = spark.read.schema("part int, base long").orc(f"{path}/starts")
    if len(stored.inputFiles()) <= broadcast_files:
        base = F.broadcast(base)  # else both sides are shuffled
    if doc_ids is not None:
        stored = stored.filter(F.col("doc_id").isin(doc_ids))
    if first is not None:
        stored = stored.filter(F.col("doc_id") >= first)
    if last is not None:
        stored = stored.filter(F.col("doc_id") <= last)
    return stored.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as stored."""

    def each(batch):
        lists = batch.column("ids")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches):
        for batch in batches:
            yield each(batch)

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
