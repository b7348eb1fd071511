"""Helpers shared by the training-data operators: table access, the shared
scratch folder and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below the folder all executors share.

    The session's ``spark.checkpoint.dir`` is used. Where it is unset, a local
    master gets a temporary folder of its own; a cluster without a shared
    folder is refused, as files on one machine would be missed by the others.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
        if root:
            root = root.rstrip("/").rpartition("/")[0]
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/keystrata-{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, is
    computed once, and survives the loss of any executor."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; other columns of
    whatever name are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class Memo(dict):
    """What a worker remembers from batch to batch and task to task: ``find``
    of each key that was asked for.

    The entries' bytes are estimated. When they pass half of ``most`` they
    become the older half, from which asking takes an entry back, and what
    was older is forgotten. Workers outlive their stage, so the first task of
    another owner empties what the one before it left.
    """

    every: list[Memo] = []

    def __init__(self, owner: str, find: Callable, most: int = 24 << 20):
        super().__init__()
        self.owner, self.find, self.most, self.held, self.older = owner, find, most, 0, {}
        Memo.every.append(self)

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        self[key] = value
        self.held += 180 + len(key) + (len(value) if isinstance(value, bytes) else 32)
        return value

    def forget(self) -> None:
        self.clear()
        self.held, self.older = 0, {}

    def begin(self) -> None:
        """To be called before each batch."""
        for other in Memo.every:
            if other.owner != self.owner and (other or other.older):
                other.forget()
        if self.held > self.most // 2:
            self.age()

    def age(self) -> None:
        self.older = dict(self)
        self.clear()
        self.held = 0


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text (one
    longer text is a slice of its own), which bounds a worker's memory."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(texts).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + (n or 0) > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def map_slices(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", max_bytes: int = 2 << 20) -> DataFrame:
    """mapInArrow over slices of bounded size."""

    def run(batches):
        for part in text_slices(batches, column, max_bytes):
            out = each(part)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
