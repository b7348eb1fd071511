"""Token counts without token ids.

1. Texts are normalised and cut into pre-tokens; a block of documents keeps
   its distinct pre-tokens, dealt into hash buckets, and the per-document
   frequencies of each.
2. A bucket brings the equal pre-tokens of all blocks together, and the
   library's model counts each distinct one once.
3. The counts return to their blocks, which sum frequency times count per
   document.

What is shuffled by pre-token is a block's short list per bucket, so a
frequent word weighs no more than a rare one: buckets are of even size
whatever the texts hold. Pre-tokens are written in the letters that stand for
bytes, among which there is no blank; a blank leads a special string, which
the library counts as it stands.

Cases: a null text counts as empty, 0 bytes and 0 tokens; a text of any length
is counted whole, one longer than a block being a block of its own; rows that
share a doc_id, or have none, are counted separately; an empty table yields no
rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_slices, whole_texts
from .tokens import byte_level, encoder

BUCKETS, BLOCK_BYTES, BLOCK_ROWS = 1024, 8 << 20, 1 << 16
REMEMBERED = 200_000  # counts that a worker keeps at most

BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, n_terms array<long>, vocabulary array<array<string>>, terms binary, frequencies binary"
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.string())), pa.binary(), pa.binary()]


class Terms:
    """A block's pre-tokens and their numbers."""

    def __init__(self, coder):
        self.coder, self.number = coder, {}
        self.special = re.compile("(" + "|".join(map(re.escape, coder.specials)) + ")") if coder.specials else None

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's pre-tokens, in order."""
        number = self.number
        if self.special and self.coder.special(text):
            parts = self.special.split(text)
            found = [x for k, part in enumerate(parts) for x in ([(" " + part,)] if k % 2 else self.coder.cut(part))]
        else:
            found = self.coder.cut(text)
        return np.fromiter((number.setdefault(x, len(number)) for x in found), np.uint32, len(found))

    def words(self) -> list[str]:
        """By number, in the letters that stand for bytes; special strings after a blank."""
        return [x[0] if isinstance(x, tuple) else byte_level(x) for x in self.number]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as four runs of bytes, lowest first, which compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def frequency_blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Blocks of documents. A document has n_terms entries in ``terms``
    (ascending pre-token numbers, as differences) and ``frequencies``; numbers
    run through the buckets of ``vocabulary`` in order."""

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer, False)
        for batch in text_slices(batches, max_bytes=BLOCK_BYTES, max_rows=BLOCK_ROWS):
            terms = Terms(coder)
            sizes, owned, times = [], [], []
            for text in batch.column("text").to_pylist():
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                own, n = np.unique(terms.numbers(text), return_counts=True)
                owned.append(own)
                times.append(n.astype(np.uint32))
            words = terms.words()
            del terms
            bucket = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            vocabulary = [[words[k] for k in order[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = np.concatenate(times)
            pairs = np.repeat(np.arange(len(sizes)) << 32, list(map(len, owned))) | place[np.concatenate(owned)]
            order = np.argsort(pairs)
            pairs, counts = pairs[order], counts[order]
            owner, term = pairs >> 32, pairs & 0xFFFFFFFF
            steps = np.diff(term, prepend=0)
            heads = np.diff(owner, prepend=-1) != 0
            steps[heads] = term[heads]
            row = [task << 32 | made, batch.column("doc_id").to_pylist(), sizes, np.bincount(owner, minlength=len(sizes)), vocabulary, _planes(steps), _planes(counts)]
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return whole_texts(docs).mapInArrow(run, BLOCKS)


def count_pieces(lists: DataFrame, tokenizer: str) -> DataFrame:
    """block, bucket and ``pieces``, the counts of the list ``words`` in order.
    Rows are dealt by bucket, so that one task has all of a pre-token."""

    def run(batches):
        coder = encoder(tokenizer, False)
        known, last = {}, None
        for batch in batches:
            out = []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                words = words.as_py()
                if bucket != last or len(known) > REMEMBERED:  # the next bucket's pre-tokens are others
                    known, last = {}, bucket
                for w in set(words).difference(known):
                    known[w] = len(coder.tokenizer.encode(w[1:], add_special_tokens=False)) if w[0] == " " else len(coder.tokenizer.model.tokenize(w))
                out.append(_planes(np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "pieces"])

    dealt = lists.select("block", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, pieces binary")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    blocks = materialize(frequency_blocks(docs, tokenizer))
    lists = blocks.select("block", F.posexplode("vocabulary").alias("bucket", "words")).filter(F.size("words") > 0)
    counted = count_pieces(lists, tokenizer).groupBy("block").agg(F.collect_list(F.struct("bucket", "pieces")).alias("counts"))  # BUCKETS at most
    whole = blocks.drop("vocabulary").join(counted, "block", "left").drop("block")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted((c["bucket"], c["pieces"]) for c in row["counts"] or [])
                pieces = np.concatenate([np.empty(0, np.int64), *(_numbers(x) for _, x in parts)])
                n = np.array(row["n_terms"], np.int64)
                steps, times = _numbers(row["terms"]), _numbers(row["frequencies"])
                ends = np.cumsum(n)
                sums = np.cumsum(steps)
                before = np.concatenate(([0], sums))[ends - n]
                weighed = np.concatenate(([0], np.cumsum(pieces[sums - np.repeat(before, n)] * times)))
                totals = weighed[ends] - weighed[ends - n]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(totals), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
