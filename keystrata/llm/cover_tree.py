"""Exact top-k by inner product with a dual cover-tree search.

1. Rows are dealt to the nearest of a few pivots, large groups in parts, and
   packed, with the queries among them, into blocks of bounded size; each block
   is a cover tree with a root: a centre and a radius that covers it.
2. The roots of the data blocks are gathered in directory pages. For a query
   block and a data block the product of any query and any vector is at most
   ``c.d + r|d| + s|c| + rs`` (centres c and d, radii r and s). Each query
   block first searches the data block of the greatest bound, which gives
   each of its queries a kth score to beat; then the next best blocks; then
   all that is left. Before each round the blocks whose bound is under the
   worst kth score of the query block are left out, before any tree is moved.
3. A cell, one query block against one data block, walks both trees at once,
   best bound first, and leaves out pairs of nodes by the same bound and the
   worst kth score of the query group. The best of all cells are merged per
   query. Products are of integers and exact.

Blocks of queries are broadcast only while their measured size is below
``broadcast_bytes`` and shuffled to the cells beyond it.

Cases: vectors that are null, or hold a null or non-finite component, take no
part; vectors of unequal length are compared as if padded by zeros; a repeated
row is a candidate of its own, and a query leaves out only its own row; rows
with a null id are no queries and, as candidates, come last in a tie; ties go
to the smaller id; an empty table, or one without queries, yields no rows;
other columns are left out.
"""

from __future__ import annotations

import heapq
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

NONE = np.iinfo(np.int64).max  # stands for a null id in ties


class Tree(NamedTuple):
    """Points in tree order; node i holds points lo[i]..hi[i], and its
    children are the nodes first[i]..last[i] (none: a leaf)."""

    points: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = 24) -> Tree:
    """A cover tree, level by level: the children of a node of radius R are
    points over R/2 apart that cover it within R/2, its centre first."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    nodes: list[list] = []  # lo, hi, centre, radius, first, last

    def node(lo: int, hi: int, centre: np.ndarray) -> list:
        d = x[order[lo:hi]] - centre
        return [lo, hi, centre, float(np.sqrt(np.einsum("ij,ij->i", d, d).max())), 0, 0]

    if len(x):
        nodes.append(node(0, len(x), x[0]))
    at = 0
    while at < len(nodes):
        lo, hi, centre, radius, _, _ = nodes[at]
        if hi - lo > leaf and radius > 0:
            left, groups, pick = order[lo:hi], [], centre
            while len(left):
                d = x[left] - pick
                near = np.einsum("ij,ij->i", d, d) <= (radius / 2) ** 2
                groups.append((left[near], pick))
                left = left[~near]
                if len(left):
                    pick = x[left[0]]
            # centres that cover a few points only share a leaf
            big = [g for g in groups if len(g[0]) > leaf]
            small = [g for g in groups if len(g[0]) <= leaf]
            bundles, held = [], []
            for g in small:
                if held and sum(len(h[0]) for h in held) + len(g[0]) > leaf:
                    bundles.append(held)
                    held = []
                held.append(g)
            bundles += [held] if held else []
            parts = [*big, *((np.concatenate([h[0] for h in b]), b[0][1]) for b in bundles)]
            nodes[at][4] = len(nodes)
            where = lo
            for members, middle in parts:
                order[where : where + len(members)] = members
                nodes.append(node(where, where + len(members), middle))
                where += len(members)
            nodes[at][5] = len(nodes)
        at += 1
    pick = lambda k, kind: np.array([n[k] for n in nodes], kind)
    dim = points.shape[1] if points.ndim == 2 else 0
    return Tree(points[order], ids[order], rows[order], pick(0, int), pick(1, int), pick(2, float).reshape(len(nodes), dim), pick(3, float), pick(4, int), pick(5, int))


def _products(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Exact integer products; object arithmetic where doubles could round."""
    return (a @ b.T).astype(np.int64) if small else (a.astype(object) @ b.astype(object).T)


def _under(score: int) -> float:
    """A double not above the score: itself, if doubles hold it."""
    return float(score) if abs(score) < 2**52 else score - abs(score) * 1e-15


def search(q: Tree, d: Tree, k: int, floor: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """For each query of ``q`` in tree order its best (-score, id, row) of
    ``d``, those under its ``floor`` left out."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in q.rows]
    worst = np.full(len(q.rows), -np.inf) if floor is None else floor.copy()
    if not len(q.rows) or not len(d.rows):
        return best
    small = float(np.abs(q.points.astype(float)).max(initial=0)) * float(np.abs(d.points.astype(float)).max(initial=0)) * max(1, q.points.shape[1]) < 2**52
    qx, dx = (t.points.astype(np.float64) if small else t.points for t in (q, d))
    q_norm, d_norm = (np.sqrt(np.einsum("ij,ij->i", t.centre, t.centre)) for t in (q, d))

    def bounds(a, b):
        top = q.centre[a] @ d.centre[b].T if np.ndim(b) == 0 else d.centre[b] @ q.centre[a]
        top = top + q.radius[a] * d_norm[b] + d.radius[b] * q_norm[a] + q.radius[a] * d.radius[b]
        return top + 1e-9 * (np.abs(top) + (q_norm[a] + q.radius[a]) * (d_norm[b] + d.radius[b])) + 1e-6  # rounding only widens

    heap = [(-float(bounds(0, np.array([0]))[0]), 0, 0)]
    while heap:
        top, a, b = heapq.heappop(heap)
        lo, hi = q.lo[a], q.hi[a]
        if -top < worst[lo:hi].min():
            continue
        a_leaf, b_leaf = q.first[a] == q.last[a], d.first[b] == d.last[b]
        if a_leaf and b_leaf:
            scores = _products(qx[lo:hi], dx[d.lo[b] : d.hi[b]], small)
            ids, rows = d.ids[d.lo[b] : d.hi[b]], d.rows[d.lo[b] : d.hi[b]]
            for i in np.flatnonzero((scores.max(axis=1) >= worst[lo:hi]).astype(bool)):
                own = scores[i]
                at = np.flatnonzero((own >= worst[lo + i]).astype(bool) & (rows != q.rows[lo + i]))
                merged = heapq.nsmallest(k, best[lo + i] + [(-int(own[j]), int(ids[j]), int(rows[j])) for j in at])
                best[lo + i] = merged
                if len(merged) == k:
                    worst[lo + i] = max(worst[lo + i], _under(-merged[-1][0]))
        elif b_leaf or (not a_leaf and q.radius[a] > d.radius[b]):
            kids = np.arange(q.first[a], q.last[a])
            for kid, value in zip(kids.tolist(), bounds(kids, b).tolist(), strict=True):
                if value >= worst[q.lo[kid] : q.hi[kid]].min():
                    heapq.heappush(heap, (-value, kid, b))
        else:
            kids = np.arange(d.first[b], d.last[b])
            least = worst[lo:hi].min()
            for kid, value in zip(kids.tolist(), bounds(a, kids).tolist(), strict=True):
                if value >= least:
                    heapq.heappush(heap, (-value, a, kid))
    return best


def _matrix(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:dim]
    return out


def _stacked(lists, width: int) -> np.ndarray:
    """A list array as rows of ``width`` numbers, cut or padded by zeros."""
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if len(ends) > 1 else np.empty(0, np.int64)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] >= width:
        return flat.reshape(len(sizes), sizes[0])[:, :width]
    return _matrix(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], width)


def _unpack(data: bytes) -> Tree:
    return Tree(*pickle.loads(data))


def dealt(vectors: DataFrame, is_query, data_rows: int, most_pivots: int = 2048) -> DataFrame:
    """row, grp, part, id, vector and query: each row with the nearest of at
    most ``most_pivots`` pivots, those of smallest hash, one for each
    ``data_rows`` rows; a group of over ``data_rows`` rows is cut into parts."""
    rows = materialize(vectors.select("id", "vector", is_query.alias("query")))
    turn = F.xxhash64("vector", F.lit(29))
    count = max(1, min(most_pivots, rows.count() // data_rows))
    pivots = [r["vector"] for r in rows.select("vector").distinct().orderBy(turn, "vector").limit(count).collect()] or [[]]
    width = max(map(len, pivots))
    middles = _matrix(pivots, width).astype(np.float64)
    half = np.einsum("ij,ij->i", middles, middles) / 2

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _stacked(batch.column("vector"), width).astype(np.float64)
            near = np.argmax(x @ middles.T - half, axis=1)
            own = np.arange(seen, seen + len(x)) | task << 40
            seen += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(near.astype(np.int32)), *(batch.column(c) for c in ("id", "vector", "query"))], names=["row", "grp", "id", "vector", "query"])

    placed = materialize(rows.mapInArrow(run, "row long, grp int, id long, vector array<long>, query boolean"))
    parts = placed.groupBy("grp").agg(F.ceil(F.count("*") / data_rows).cast("int").alias("parts"))  # most_pivots rows at most
    return placed.join(F.broadcast(parts), "grp").withColumn("part", F.pmod(F.xxhash64("row", F.lit(37)), F.col("parts")).cast("int")).drop("parts")


BLOCKS = "query boolean, block long, n long, middle array<double>, reach double, tree binary"


def index(rows: DataFrame, data_rows: int = 4096, query_rows: int = 1024, leaf: int = 24) -> DataFrame:
    """A row for each block of the rows that ``dealt`` gives: its tree, and
    the mean of its points with the distance that covers them all."""

    def packed(kind: bool, number: int, held: list[tuple]) -> pa.RecordBatch:
        width = max(x.shape[1] for *_, x in held)
        ids, own = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        x = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for *_, x in held])
        if x.size and np.abs(x).max() < 2**15:
            x = x.astype(np.int16)
        middle = x.astype(np.float64).mean(axis=0)
        d = x - middle
        reach = float(np.sqrt(np.einsum("ij,ij->i", d, d).max(initial=0)))
        kinds = {"query": pa.bool_(), "middle": pa.list_(pa.float64()), "reach": pa.float64(), "tree": pa.binary()}
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        values = [kind, number, len(ids), middle.tolist(), reach, pickle.dumps(tuple(build(x, ids, own, leaf)), protocol=5)]
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n, pa.int64())) for n, v in zip(names, values, strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        task, made, last = TaskContext.get().partitionId(), 0, None
        held: dict[bool, list[tuple]] = {False: [], True: []}
        most = {False: data_rows, True: query_rows}

        def full(kind: bool, n: int) -> bool:
            return bool(held[kind]) and sum(len(h[0]) for h in held[kind]) + n > most[kind]

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("grp", "part")], axis=1)
            ids = batch.column("id").fill_null(NONE).to_numpy()
            own, asks, vectors = batch.column("row").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False), batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            # stretches of one group, one length, and no more rows than a block of queries has
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1) | (lengths[1:] != lengths[:-1])) + 1
            edges = sorted({0, len(ids), *cuts.tolist(), *range(0, len(ids), min(most.values()))})
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = _stacked(vectors.slice(a, b - a), int(lengths[a]))
                here = tuple(group[a])
                for kind in (False, True):
                    pick = np.flatnonzero(asks[a:b]) if kind else np.arange(b - a)
                    if here != last and held[kind] or full(kind, len(pick)):
                        yield packed(kind, task << 32 | made, held[kind])
                        held[kind] = []
                        made += 1
                    if len(pick):
                        held[kind].append((ids[a:b][pick], own[a:b][pick], x[pick]))
                last = here
        for kind in (False, True):
            if held[kind]:
                yield packed(kind, task << 32 | made, held[kind])
                made += 1

    return rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "row").mapInArrow(run, BLOCKS)


def quantised(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """id and vector, whose components are floor(scale * x); whole vectors only."""
    x = F.col(vector_column).cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.filter(x.isNotNull() & fit).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).cast("array<long>").alias("vector"))


PAGE = 4096  # roots in a page of the directory


def directory(data: DataFrame) -> DataFrame:
    """page and roots: the roots of PAGE data blocks at most, in a row."""

    def run(batches):
        from pyspark import TaskContext

        task, held, made = TaskContext.get().partitionId(), [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([pickle.dumps(held, protocol=5)], pa.binary())], names=["page", "roots"])
        for batch in batches:
            for root in zip(*(batch.column(c).to_pylist() for c in ("block", "middle", "reach")), strict=True):
                held.append(root)
                if len(held) == PAGE:
                    yield row()
                    held, made = [], made + 1
        if held:
            yield row()

    return data.select("block", "middle", "reach").coalesce(32).mapInArrow(run, "page long, roots binary")


def block_pairs(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """cell, block and bound of the data blocks whose bound reaches ``floor``,
    the worst kth score of the query block so far. queries: cell, middle,
    reach, floor, done (blocks searched already); a row meets each page."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for cell, middle, reach, floor, done, roots in zip(*(batch.column(c).to_pylist() for c in ("cell", "middle", "reach", "floor", "done", "roots")), strict=True):
                roots = pickle.loads(roots)
                width = max(len(middle), *(len(m) for _, m, _ in roots))
                wide = lambda x: np.pad(np.asarray(x, np.float64), (0, width - len(x)))  # noqa: B023, E731
                c, d, s = wide(middle), np.stack([wide(m) for _, m, _ in roots]), np.array([r for *_, r in roots])
                c_norm, d_norm = np.sqrt(c @ c), np.sqrt(np.einsum("ij,ij->i", d, d))
                top = d @ c + reach * d_norm + s * c_norm + reach * s
                top += 1e-9 * (np.abs(top) + (c_norm + reach) * (d_norm + s)) + 1e-6  # rounding only widens
                for k in np.flatnonzero(top >= (-np.inf if floor is None else floor)):
                    if roots[k][0] not in done:
                        for column, v in zip(out, (cell, roots[k][0], float(top[k])), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["cell", "block", "bound"])

    numbers = [r["page"] for r in pages.select("page").collect()]  # one for each PAGE blocks
    met = queries.withColumn("page", F.explode(F.lit(numbers).cast("array<bigint>"))).join(pages, "page")
    return met.select("cell", "middle", "reach", "floor", "done", "roots").mapInArrow(run, "cell long, block long, bound double")


FOUND = "cell long, query_row long, query_id long, vec_id long, score long, row long"


def searched(pairs: DataFrame, data: DataFrame, queries: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """The best of each cell of ``pairs`` (cell, block). floors: cell and
    floors, a list of (query_row, kth score so far)."""
    cells = pairs.select("cell", "block").join(data.select("block", "tree"), "block").join(queries, "cell")
    cells = cells.withColumn("floors", F.lit(None).cast("array<struct<query_row:bigint,kth:bigint>>")) if floors is None else cells.join(floors, "cell", "left")

    def run(batches):
        for batch in batches:
            for cell, d, q, known in zip(*(batch.column(c) for c in ("cell", "tree", "query_tree", "floors")), strict=True):
                q, d = _unpack(q.as_py()), _unpack(d.as_py())
                width = max(q.points.shape[1], d.points.shape[1])
                wide = lambda t: t._replace(points=np.pad(t.points, ((0, 0), (0, width - t.points.shape[1]))), centre=np.pad(t.centre, ((0, 0), (0, width - t.centre.shape[1]))))  # noqa: B023, E731
                kth = {x["query_row"]: _under(x["kth"]) for x in known.as_py() or []}
                best = search(wide(q), wide(d), k, np.array([kth.get(int(r), -np.inf) for r in q.rows], np.float64))
                flat = [(cell.as_py(), int(row), int(i), vec, -score, other) for row, i, own in zip(q.rows, q.ids, best, strict=True) for score, vec, other in own]
                columns = list(zip(*flat, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])

    return cells.select("cell", "tree", "query_tree", "floors").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query, k: int = 5, broadcast_bytes: int = 32 << 20, first: int = 8, data_rows: int = 4096, query_rows: int = 1024, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query
    row. ``report`` receives the numbers of block pairs, and of those searched."""
    trees = materialize(index(dealt(vectors, is_query, data_rows), data_rows, query_rows))
    data = trees.filter("not query")
    asking = trees.filter("query").withColumnRenamed("block", "cell")
    size = asking.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("tree")), F.lit(0)).alias("bytes")).first()
    queries = asking.select("cell", F.col("tree").alias("query_tree"))
    if size["bytes"] <= broadcast_bytes:
        queries = F.broadcast(queries)
    pages = materialize(directory(data))
    best = done = floors = None
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    met = 0
    for take in (1, first, None):
        state = asking.select("cell", "n", "middle", "reach")
        if best is None:
            state = state.withColumn("floor", F.lit(None).cast("long")).withColumn("done", F.array().cast("array<bigint>"))
        else:
            kth = best.filter(F.col("rank") == k).select("cell", "query_row", F.col("score").alias("kth"))
            floors = kth.groupBy("cell").agg(F.collect_list(F.struct("query_row", "kth")).alias("floors"), F.min("kth").alias("least"), F.count("*").alias("full"))  # query_rows at most
            state = state.join(floors.drop("floors"), "cell", "left").join(done.groupBy("cell").agg(F.collect_list("block").alias("done")), "cell", "left")  # 1 + first at most
            state = state.withColumn("floor", F.when(F.col("full") == F.col("n"), F.col("least"))).withColumn("done", F.coalesce("done", F.array().cast("array<bigint>")))
            floors = floors.select("cell", "floors")
        pairs = block_pairs(state.select("cell", "middle", "reach", "floor", "done"), pages)
        if take is not None:
            nearest = Window.partitionBy("cell").orderBy(F.desc("bound"), "block")
            pairs = pairs.withColumn("i", F.row_number().over(nearest)).filter(F.col("i") <= take)
        pairs = materialize(pairs.select("cell", "block"))
        met += pairs.count() if report is not None else 0
        found = searched(pairs, data, queries, floors, k)
        best = materialize((found if best is None else best.drop("rank").union(found)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        done = pairs if done is None else done.union(pairs)
    if report is not None:
        report |= {"pairs": size["n"] * data.count(), "searched": met}
    vec = F.when(F.col("vec_id") != int(NONE), F.col("vec_id"))
    return best.select("query_id", "rank", vec.alias("vec_id"), "score")
