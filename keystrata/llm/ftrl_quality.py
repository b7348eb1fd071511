"""Quality classifier: logistic regression over hashed word n-grams, trained
with follow-the-regularised-leader updates and scored as sparse dot products.

N-grams of one to three words are taken in two views: the lower-cased words,
and each word's form (case, digits, the mark itself, or "as before" for a
repeated word). Counts enter by their square root, scaled to unit length.

Training sees at most ``most`` labelled rows, those of smallest hash; this
bound keeps the one training task and the weights of a fixed size. Scoring
covers every whole text.

Cases: a null text counts as empty, whose score is that of the bias alone; a
text of any length is scored whole, as one unit vector;
labels that are null or for unknown documents are ignored; of a document's
several labels the largest counts; rows that share a doc_id are scored
separately; a null doc_id is not held out; without labels every score is 0.5;
an empty table yields no rows; other columns are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memo, map_slices, text_slices, whole_texts

BITS, ORDERS = 18, 3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = xxhash.xxh64_intdigest(b"same", seed=2)
_STEPS = (np.random.default_rng(7).integers(0, 2**63, 2 * ORDERS * ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(2, ORDERS, ORDERS)

_hashes: list[tuple[int, int]] = []


def _form(word: str) -> str:
    if not word[0].isalnum():
        return word[:1]
    if word.isdigit():
        return "0"
    if word.isupper() and len(word) > 1:
        return "AA"
    return "Aa" if word[0].isupper() else "a"


def _number(word: str) -> int:
    _hashes.append((xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(_form(word), seed=1)))
    return len(_hashes) - 1


class _Numbers(Memo):
    """Words' places in _hashes, forgotten together with it."""

    def forget(self) -> None:
        super().forget()
        _hashes.clear()

    age = forget


_known = _Numbers("words of the quality classifier", _number, 48 << 20)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values."""
    _known.begin()
    words = _TOKEN.findall(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    ids = np.fromiter(map(_known.__getitem__, words), np.int64, len(words))
    distinct, back = np.unique(ids, return_inverse=True)
    table = np.array([_hashes[i] for i in distinct], np.uint64)[back]
    views = [table[:, 0], table[:, 1].copy()]
    views[1][1:][ids[1:] == ids[:-1]] = _SAME
    found = []
    for view, steps in zip(views, _STEPS, strict=True):
        for order in range(min(ORDERS, len(ids))):
            n = len(ids) - order
            total = np.zeros(n, np.uint64)
            for k in range(order + 1):
                total += (view[k : k + n] ^ np.uint64(order)) * steps[order, k]
            found.append(((total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    at, counts = np.unique(np.concatenate(found).astype(np.int64), return_counts=True)
    value = np.sqrt(counts)
    return at, value / np.sqrt((value * value).sum())


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights, the bias last, from rows of (label, feature numbers, values)."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias = np.array([size - 1]), np.array([0.3])
    for _ in range(passes):
        for label, at, value in rows:
            at, value = np.concatenate((at, bias[0])), np.concatenate((value, bias[1]))
            own = z[at]
            weight = np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(weight @ value, -35, 35)))
            g = (p - label) * value
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * weight
            n[at] += g * g
    rest = np.abs(z) > l1
    w[rest] = -(z[rest] - np.sign(z[rest]) * l1) / ((beta + np.sqrt(n[rest])) / alpha + l2)
    return w


def score(w: np.ndarray, at: np.ndarray, value: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[at] @ value + 0.3 * w[-1], -35, 35))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000) -> np.ndarray:
    """The weights, from labelled rows that are not held out."""
    doc_id = F.col("doc_id").cast("long")
    usable = labels.select(doc_id.alias("doc_id"), "quality").filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(11))
    one = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).withColumn("turn", order).orderBy("turn", "doc_id").limit(most)
    # at most ``most`` rows of three numbers
    labelled = whole_texts(docs).join(F.broadcast(one), "doc_id")

    def extract(batch):
        pairs = [features(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("turn"), batch.column("label"), pa.array([a.astype("<i4").tobytes() for a, _ in pairs], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["turn", "label", "at", "value"])

    sparse = map_slices(labelled.select("turn", "label", "text"), extract, "turn long, label double, at binary, value binary")

    def fit(batches):
        rows = []
        for batch in batches:
            for label, at, value in zip(*(batch.column(c).to_pylist() for c in ("label", "at", "value")), strict=True):
                rows.append((label, np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(value, "<f4").astype(float)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    # repeated documents could pass the bound: the first rows by turn train
    found = sparse.orderBy("turn", "at").limit(most).repartition(1).sortWithinPartitions("turn", "at").select("label", "at", "value").mapInArrow(fit, "weights binary").first()
    return np.frombuffer(found["weights"], "<f4").astype(float) if found else np.zeros((1 << BITS) + 1)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 8000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most).astype(np.float32))  # 2^BITS + 1 numbers

    def run(batches):
        w = weights.value.astype(float)
        for batch in text_slices(batches):
            scores = np.array([score(w, *features(t)) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = whole_texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = 8000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most).astype(np.float32))
    schema, names = docs.schema, docs.columns

    def run(batches):
        w = weights.value.astype(float)
        for batch in text_slices(batches):
            keep = pa.array([score(w, *features(t or "")) >= threshold for t in batch.column(names.index("text")).to_pylist()])
            yield batch.filter(keep)

    return docs.mapInArrow(run, schema)
