"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes), a
   MinHash signature and its band keys. Equal sets are one class, whose
   smallest document stands for it.
2. Classes that share a band key are candidates. A bucket is dealt into cells
   of bounded size, in which signatures are compared batch by batch: a pair is
   dropped when the posterior probability that its similarity reaches the
   threshold falls below ``miss``. A cell gives a spanning forest of the pairs
   that are left, never all of them, and pairs that the forest connects
   already are not compared, so n alike texts cost about n comparisons.
   Buckets of over HOT classes are dealt anew by sharper bands first, which
   texts that only share a passage seldom have in common.
3. Only what the signatures connect is grouped for verification. A group is
   dealt into blocks of bounded rows and bytes; a cell is a pair of blocks, in
   which the same candidates, pruned in the same way, are verified on their
   full sets unless confirmed links connect them already.
4. Components of confirmed links are found by contraction with random
   priorities.

Cases: texts without words, and null texts, have an empty set and are linked
with nothing; a text of fewer than five words is one shingle; a text of any
length is taken whole. In ``near_duplicates`` rows that share a doc_id are one
document, linked with all that any of its texts is linked with, and a row with
a null doc_id is linked with nothing, has a null component and is kept. In
``deduplicated`` each row is a document of its own, whatever its doc_id. An
empty table yields no rows; other columns are left out, or kept by
``deduplicated``.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import Memo, materialize, text_slices

WORDS, ROWS, BANDS, BATCH = 5, 6, 22, 12
HASHES = ROWS * BANDS
SHARP_ROWS, SHARP_BANDS = 12, 68  # a pair at 85 % misses all of them with probability 3e-5, as it does the first bands
CELL_ROWS, HOT = 1024, 8192
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS, BLOCK_BYTES = 128, 4096, 64, 16 << 20

_RANDOM = np.random.default_rng(20240607)
_odd = lambda n: _RANDOM.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS, _OFFSETS = _odd(HASHES), _odd(HASHES)
_PLACES, _ROW_FACTORS = _odd(WORDS), _odd(SHARP_ROWS)
_SHARP_FACTORS, _SHARP_OFFSETS = _odd(SHARP_ROWS * SHARP_BANDS), _odd(SHARP_ROWS * SHARP_BANDS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input counts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_word_hashes = Memo("shingles", xxhash.xxh64_intdigest, 32 << 20)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    _word_hashes.begin()
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(mixed(total))


def signature(found: np.ndarray, factors: np.ndarray = _FACTORS, offsets: np.ndarray = _OFFSETS) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(len(factors), 2**32 - 1, np.uint64)
    for k in range(0, len(found), 2048):
        part = found[k : k + 2048]
        np.minimum(least, ((part[None, :] * factors[:, None] + offsets[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int = BANDS, first: int = 0) -> np.ndarray:
    """``bands`` keys for each row of signatures, told apart by band."""
    rows = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    sums = (mixed(rows + np.uint64(1)) * _ROW_FACTORS[: rows.shape[2]]).sum(axis=2, dtype=np.uint64)
    return mixed(sums + np.arange(first, first + bands, dtype=np.uint64))


def least_matches(n: int, percent: int, miss: float) -> int:
    """Of n compared values, the fewest equal ones at which the posterior
    probability (uniform prior) of a similarity of at least ``percent``
    reaches ``miss``."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(n: int, left: np.ndarray, right: np.ndarray | None, alike, confirm=None) -> np.ndarray:
    """For each of n things the smallest one that links connect it with.

    ``right`` None: all pairs of ``left`` count, else those across. alike(x,
    others) gives the candidates among others, the likeliest first, and
    confirm(x, y) decides; None takes them all.
    """
    label = np.arange(n)

    def join(found) -> None:
        label[np.isin(label, found)] = found.min()

    for i, x in enumerate(left):
        other = left[i + 1 :] if right is None else right
        other = other[label[other] != label[x]]
        if not len(other):
            continue
        other = alike(x, other)
        if confirm is None:
            if len(other):
                join(np.append(label[other], label[x]))
            continue
        for y in other:
            if label[x] != label[y] and confirm(x, y):
                join(label[[x, y]])
    return label


def bayes(signatures: np.ndarray, percent: int, miss: float):
    """alike(x, others): the others that sequential comparison leaves."""
    steps = [(k, min(k + BATCH, HASHES)) for k in range(0, HASHES, BATCH)]
    floors = [least_matches(b, percent, miss) for _, b in steps]

    def alike(x, other):
        same = np.zeros(len(other), np.int64)
        for (a, b), floor in zip(steps, floors, strict=True):
            same += (signatures[other, a:b] == signatures[x, a:b]).sum(axis=1)
            keep = same >= floor
            other, same = other[keep], same[keep]
            if not len(other):
                break
        return other[np.argsort(-same, kind="stable")]

    return alike


def links_in_cell(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int, miss: float) -> list[int]:
    """For each set the smallest number of a set that confirmed links connect
    it with, as in ``forest``."""
    signatures = np.stack([signature(s) for s in sets])
    bands = band_keys(signatures)
    sizes = np.array([len(s) for s in sets])
    left_over = bayes(signatures, percent, miss)

    def alike(x, other):
        other = other[100 * np.minimum(sizes[other], sizes[x]) >= percent * np.maximum(sizes[other], sizes[x])]
        return left_over(x, other[(bands[other] == bands[x]).any(axis=1)])

    return forest(len(sets), left, right, alike, lambda x, y: linked(sets[x], sets[y], percent)).tolist()


_SKETCH = "uid long, doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary, text string"


def sketched(docs: DataFrame, whole: bool = False) -> DataFrame:
    """uid, doc_id, n_shingles, fingerprint, band keys, signature (a byte of
    each value) and text of each row; ``whole`` adds ``row``, all other
    columns, and ``no_text``, whether the text was null."""
    kept = [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id")]
    if whole:
        rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # no name in it can clash
        kept += [rest.alias("row"), F.col("text").isNull().alias("no_text")]
    narrow = docs.select(*kept)
    schema = StructType.fromDDL(_SKETCH)
    for name in narrow.columns[2:]:
        schema.add(narrow.schema[name])

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            signatures = np.stack([signature(s) for s in sets])
            bands = band_keys(signatures).view(np.int64)
            uid = (np.arange(len(sets)) + seen) | task << 40
            seen += len(sets)
            sums = [np.array([f(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for f in (lambda s: s, lambda s: mixed(s ^ np.uint64(0x5851F42D4C957F2D)))]
            low = [x.tobytes() for x in signatures.astype(np.uint8)]
            columns = [pa.array(uid), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array(low, pa.binary()), batch.column("text")]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=schema.names)

    return narrow.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the links u, v.

    Each round every node moves to the neighbour, or itself, of least random
    priority, and links are drawn anew between what is left; the number of
    nodes falls by a constant factor a round, whatever the links' shape.
    """
    edges = materialize(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    names, turn = None, 0
    while edges.limit(1).count():
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        moved = both.groupBy("node").agg(F.min(rank("other")).alias("best")).select("node", F.least("best", rank("node"))["id"].alias("to"))
        moved = materialize(moved)
        first, second = moved.toDF("u", "p"), moved.toDF("v", "q")
        edges = materialize(edges.join(first, "u").join(second, "v").filter("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        if names is None:
            names = moved.select("node", F.col("to").alias("at"))
        else:
            names = names.join(moved.toDF("at", "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        names = materialize(names)
        turn += 1
    if names is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = materialize(names.groupBy("at").agg(F.min("node").alias("component")))
    return materialize(names.join(least, "at").select("node", "component"))


def sharp_keys(texts: DataFrame) -> DataFrame:
    """node and key of SHARP_BANDS bands of texts (node, text)."""

    def run(batches):
        for batch in text_slices(batches):
            found = np.stack([signature(shingles(t), _SHARP_FACTORS, _SHARP_OFFSETS) for t in batch.column("text").to_pylist()])
            keys = band_keys(found, SHARP_BANDS, BANDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), SHARP_BANDS).cast(pa.list_(pa.int64()))], names=["node", "keys"])

    return texts.select("node", "text").mapInArrow(run, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def shared(keyed: DataFrame) -> DataFrame:
    """key and n of the keys that several nodes have; counted map by map, so a
    frequent key is no task's burden."""
    found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    return found.filter("least < most").select("key", "n")


def bucket_cells(classes: DataFrame, texts: DataFrame, hot: int = HOT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """key, i, j, own and node: the members of each cell of each bucket.
    classes: node, bands; texts: node, text, read for hot buckets alone."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    common = materialize(shared(keyed))
    members = materialize(keyed.join(common, "key"))
    crowd = members.filter(F.col("n") > hot)
    if crowd.limit(1).count():
        sharp = materialize(sharp_keys(texts.join(crowd.select("node").distinct(), "node")))
        members = members.filter(F.col("n") <= hot).select("key", "node", "n").union(sharp.join(shared(sharp), "key").select("key", "node", "n"))
    blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(41)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")


def surviving_links(cells: DataFrame, sketches: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links u, v that connect what sequential comparison leaves in each cell.
    sketches: node, sketch."""

    def solve(rows):
        own = np.array([r[0] for r in rows])
        nodes = np.array([r[1] for r in rows])
        signatures = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), HASHES)
        first = np.flatnonzero(own == own[0])
        second = None if len(first) == len(own) else np.flatnonzero(own != own[0])
        label = forest(len(rows), first, second, bayes(signatures, percent, miss))
        moved = np.flatnonzero(nodes[label] != nodes)
        return list(zip(nodes[label[moved]].tolist(), nodes[moved].tolist(), strict=True))

    return _per_cell(cells.join(sketches, "node"), ["key", "i", "j"], ["own", "node", "sketch"], lambda key, rows: [] if key[1] != key[2] and len({r[0] for r in rows}) < 2 else solve(rows))


def _per_cell(rows: DataFrame, cell: list[str], columns: list[str], solve) -> DataFrame:
    """Links u, v from the rows of each cell, each cell in one task."""
    dealt = rows.select(*cell, *columns).repartition(*cell).sortWithinPartitions(*cell)

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*cell, *columns)), strict=True):
                if row[: len(cell)] != key:
                    out += solve(key, held) if len(held) > 1 else []
                    key, held = row[: len(cell)], []
                held.append(row[len(cell) :])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
        out = solve(key, held) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def confirmed_links(texts: DataFrame, clusters: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links u, v that connect, within each cluster, what full sets confirm.
    texts: uid, node, text; clusters: node, cluster."""
    members = materialize(texts.join(clusters, "node"))
    sums = materialize(members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("size")))
    # small blocks spread a group over many tasks; larger ones keep a large group's copies few
    rows_each = F.least(F.lit(MOST_BLOCK_ROWS), F.greatest(F.lit(BLOCK_ROWS), F.col("n") / BLOCKS))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_each), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    placed = members.join(sums, "cluster").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    celled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    celled = celled.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")

    def solve(key, rows):
        _, i, j = key
        sets = [shingles(t) for _, _, t in rows]
        own = np.array([r[0] for r in rows])
        left, right = (np.arange(len(rows)), None) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        roots = links_in_cell(sets, left, right, percent, miss)
        return [(rows[k][1], rows[r][1]) for k, r in enumerate(roots) if rows[k][1] != rows[r][1]]

    return _per_cell(celled, ["cluster", "i", "j"], ["own", "node", "text"], solve)


def class_components(rows: DataFrame, own: str, also: DataFrame | None, percent: int, miss: float) -> DataFrame:
    """fp1, fp2, node and component of each class of rows with equal sets;
    ``own`` names the column whose least value is a class's node, and ``also``
    holds further links u, v, made by ``also(classes)``."""
    least = rows.groupBy("fp1", "fp2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("least"))
    classes = materialize(least.select("fp1", "fp2", F.col(f"least.{own}").alias("node"), F.col("least.uid").alias("uid")))
    named = materialize(rows.select("uid", "bands", "sketch").join(classes.select("uid", "node"), "uid"))
    of_nodes = rows.select("uid", "text").join(classes.select("uid", "node"), "uid").select("uid", "node", "text")
    survived = surviving_links(bucket_cells(named, of_nodes), named.select("node", "sketch"), percent, miss)
    clusters = components(survived).withColumnRenamed("component", "cluster")
    wanted = materialize(classes.select("uid", "node").join(clusters, "node"))
    texts = rows.select("uid", "text").join(wanted.select("uid", "node"), "uid")
    links = confirmed_links(texts, clusters, percent, miss)
    found = components(links if also is None else links.union(also(classes)))
    return materialize(classes.join(found, "node", "left").select("fp1", "fp2", "node", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = materialize(sketched(docs))
    linkable = F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    some = rows.filter(linkable)

    def of_several_texts(classes: DataFrame) -> DataFrame:
        # a doc_id with different texts belongs to all their classes
        fp = F.struct("fp1", "fp2")
        several = some.groupBy("doc_id").agg(F.min(fp).alias("a"), F.max(fp).alias("b")).filter("a <> b").select("doc_id")
        return some.select("doc_id", "fp1", "fp2").join(several, "doc_id").join(classes, ["fp1", "fp2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()

    named = class_components(some, "doc_id", of_several_texts, percent, miss)
    plain = rows.select("doc_id", "n_shingles", "fp1", "fp2")
    joined = plain.filter(linkable).join(named, ["fp1", "fp2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = plain.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the
    smallest doc_id (of several such rows any one), and all rows without
    words; columns and values are as they were."""
    rows = materialize(sketched(docs, whole=True))
    some = rows.filter("n_shingles > 0")
    named = class_components(some, "uid", None, percent, miss)
    in_class = some.select("uid", "doc_id", "fp1", "fp2").join(named.select("fp1", "fp2", "component"), ["fp1", "fp2"])
    in_class = materialize(in_class.select("uid", "doc_id", "component"))
    first = in_class.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("stays"))
    gone = in_class.join(first, "component").filter("uid <> stays").select("uid")
    kept = rows.join(gone, "uid", "left_anti")
    text = F.when(~F.col("no_text"), F.col("text")).cast(docs.schema["text"].dataType)
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
