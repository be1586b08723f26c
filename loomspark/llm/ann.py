"""Nearest neighbours by a forest of random-projection trees (operator 9).

Every node of a tree has a hyperplane of its own (one of a pool of random orthonormal
vectors, named by the node's number) at the median of a bounded sample's projections;
depth follows the number of rows as far as the sample carries it. Every row is put into
a leaf of each tree. A query walks all trees through one priority queue: the side of a
split that it lies on costs nothing, the other side its distance to the plane, and the
cheapest node of any tree is opened next. Rows of the opened leaves are scored by a matrix
product, and those that may be among the nearest again exactly, in double precision.

How many leaves a query opens is measured, not set: a bounded sample of rows gets its
true neighbours by one pass over all rows, and as many leaves are opened as find
``target`` of them. So clustered vectors cost a few leaves a query whatever the size of
the table, and vectors without structure (isotropic ones in many dimensions, for which
no tree can narrow the search) cost a large share of it, but keep their recall.

Neighbouring leaves make blocks: a query is sent once to a block, with the leaves that it
opens there, and gets one list of its best back. A block with very many rows (equal vectors
fall into one leaf) is dealt out in slices, so no task holds a block of any size.

Defined results: vectors that are null, zero, of another length than the most
common one, or that hold nulls or values that aren't finite take no part, as query
or candidate; ties go to the smaller id; a query with fewer candidates than ``k``
gets all that are found (all of them in a table of one leaf); repeated ids are one
candidate for each distinct vector; other columns are left alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, keep, mix

#: Planes in the pool, and rows of the sample that a node must have to be split.
PLANES, SPLIT = 256, 16


class Forest:
    """Trees fitted to ``sample`` (rows of unit length)."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        n, d = sample.shape if sample.ndim == 2 and sample.size else (0, 1)
        self.planes = np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0].T for _ in range(-(-PLANES // d))])[:PLANES]
        self.trees, self.depth = trees, depth
        #: Of each tree a heap of nodes (node i has the children 2i and 2i + 1): its plane and where it cuts.
        self.plane = (mix(np.arange(trees * 2**depth, dtype=np.uint64) + np.uint64(seed << 40)) % np.uint64(len(self.planes))).astype(np.int64).reshape(trees, -1)
        self.cut = np.zeros((trees, 2**depth))
        projected = sample @ self.planes.T if n else np.zeros((0, len(self.planes)))
        for tree in range(trees):
            node = np.ones(n, np.int64)
            for level in range(depth):
                x = projected[np.arange(n), self.plane[tree][node]]
                order = np.lexsort((x, node))
                first = np.searchsorted(node[order], np.arange(2**level, 2 ** (level + 1) + 1))
                middle = np.minimum((first[:-1] + first[1:]) // 2, max(n - 1, 0))
                self.cut[tree, 2**level : 2 ** (level + 1)] = x[order][middle]
                node = 2 * node + (x >= self.cut[tree][node])

    @property
    def n_leaves(self) -> int:
        return self.trees * 2**self.depth

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over all trees: (rows, trees)."""
        out = np.zeros((len(rows), self.trees), np.int64)
        if not len(rows):
            return out
        projected, at = rows @ self.planes.T, np.arange(len(rows))
        for tree in range(self.trees):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (projected[at, self.plane[tree][node]] >= self.cut[tree][node])
            out[:, tree] = node - 2**self.depth + tree * 2**self.depth
        return out

    def route(self, query: np.ndarray, n_leaves: int) -> list[int]:
        """The ``n_leaves`` leaves that come first in the queue that all trees share."""
        gaps = (self.planes @ query)[self.plane] - self.cut
        queue = [(0.0, tree, 1) for tree in range(self.trees)]
        found, end = [], 2**self.depth
        gaps = gaps.tolist()
        while queue and len(found) < n_leaves:
            cost, tree, node = heapq.heappop(queue)
            while node < end:
                gap = gaps[tree][node]
                side = gap >= 0
                heapq.heappush(queue, (max(cost, abs(gap)), tree, 2 * node + 1 - side))
                node = 2 * node + side
            found.append(node - end + tree * end)
        return found


def _matrix(column) -> np.ndarray:
    """Vectors of a list column, one length each, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes; cosines stay what they are."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None]) if len(m) else m


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1))[:, None] if len(m) else m


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows that take part."""
    kind = table.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite & F.exists("embedding", lambda x: x != 0))
    length = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("embedding") == (length["n"] if length else 0)).distinct()


def _best(ids: np.ndarray, rows: np.ndarray, q_ids: list[int], queries: np.ndarray, k: int, cells: np.ndarray | None = None, wanted: list[list[int]] | None = None):
    """(query's id, id, cosine) of the ``k`` nearest of ``rows`` to each query, itself left out; with ``cells``
    (of the rows, ascending) of the rows in those that the query has ``wanted``."""
    rows, queries = _scaled(rows), _scaled(queries)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    if cells is None:
        near = (queries @ rows.T) / norms
    else:
        near = np.full((len(queries), len(rows)), -np.inf)
        leaf, by = np.concatenate(wanted).astype(np.int64), np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        order = np.argsort(leaf, kind="stable")
        leaf, by = leaf[order], by[order]
        for i, j in zip(first := np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]), [*first[1:], len(leaf)], strict=True):
            a, b = np.searchsorted(cells, [leaf[i], leaf[i] + 1])
            near[by[i:j], a:b] = queries[by[i:j]] @ rows[a:b].T / norms[a:b]
    for i, q_id in enumerate(q_ids):
        near[i, ids == q_id] = -np.inf
        near[i] /= (norm := np.sqrt(np.einsum("j,j->", queries[i], queries[i])))
        last = np.partition(near[i], -k)[-k] if len(ids) > k else -np.inf
        some = np.flatnonzero((near[i] >= last - 1e-9) & np.isfinite(near[i]))
        cos = np.einsum("ij,j->i", rows[some], queries[i]) / (norms[some] * norm)
        order = np.lexsort((ids[some], -cos))[:k]
        yield from zip([q_id] * len(order), ids[some][order].tolist(), cos[order].tolist(), strict=True)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _found(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(rows: DataFrame, n: int, k: int = 5, trees: int = 6, leaf: int = 64, sample: int = 20_000, probes: int = 96, target: float = 0.96) -> tuple[Forest, int]:
    """The forest, and the number of leaves that a query opens, from (vec_id, embedding).

    ``sample`` rows fit the planes' cuts, and so bound the depth (every row is indexed). ``probes``
    rows get their true neighbours by one pass over all rows; as many leaves are opened as find ``target`` of these."""
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(sample).toArrow()  # at most ``sample`` rows
    vectors, ids = _unit(_matrix(picked["embedding"])), np.asarray(picked["vec_id"])
    forest = Forest(vectors, trees, max(0, int(np.log2(max(1, min(n / leaf, len(vectors) / SPLIT))))))
    if forest.depth == 0:
        return forest, forest.n_leaves
    asked, asked_ids = vectors[:probes], ids[:probes].tolist()
    shared = rows.sparkSession.sparkContext.broadcast((asked_ids, asked))  # ``probes`` vectors

    def exact(batches):
        for batch in batches:
            yield _found(_best(np.asarray(batch.column("vec_id")), _matrix(batch.column("embedding")), *shared.value, k))

    true = _ranked(rows.mapInArrow(exact, "query_id long, vec_id long, score double"), k)
    true = true.select("query_id", "vec_id").join(rows, "vec_id").select("query_id", "embedding").toArrow()  # probes * k rows
    rank = {}
    for q_id, q in zip(asked_ids, asked, strict=True):
        rank[q_id] = np.empty(forest.n_leaves, np.int64)
        rank[q_id][forest.route(q, forest.n_leaves)] = np.arange(forest.n_leaves)
    needed = sorted(int(rank[q_id][at].min()) for q_id, at in zip(true["query_id"].to_pylist(), forest.leaves(_unit(_matrix(true["embedding"]))), strict=True))
    return forest, needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] + 1 if needed else forest.n_leaves


def nearest(table: DataFrame, is_query, k: int = 5, slice_rows: int = 4096, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine found for each row where ``is_query``; ``settings`` of :func:`fitted`."""
    spark = table.sparkSession
    with Scratch(spark) as cut:
        rows = cut(valid_vectors(table))
        n = rows.count()
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        forest, opened = fitted(rows, n, k, **settings)
        shared = spark.sparkContext.broadcast(forest)  # PLANES vectors and two numbers a node: bounded by the sample

        together = 2 ** min(forest.depth, max(0, int(np.log2(max(1, slice_rows * 2**forest.depth / n)))))  # neighbouring leaves of one tree that make a block of about ``slice_rows``

        def place(batches):
            for batch in batches:
                at = shared.value.leaves(_unit(_matrix(batch.column("embedding"))))
                take = pa.array(np.repeat(np.arange(len(at)), at.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel() // together), pa.array(at.ravel()), batch.column("vec_id").take(take), batch.column("embedding").take(take)], ["block", "cell", "vec_id", "embedding"])

        def route(batches):
            """A query goes once to each block of which it opens leaves."""
            for batch in batches:
                blocks, cells, take = [], [], []
                for i, q in enumerate(_unit(_matrix(batch.column("embedding")))):
                    at = np.sort(shared.value.route(q, opened))
                    first = np.flatnonzero(np.diff(at // together, prepend=-1))
                    blocks += (at[first] // together).tolist()
                    cells += np.split(at, first[1:])
                    take += [i] * len(first)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int64())), batch.column("vec_id").take(pa.array(take, pa.int64())), batch.column("embedding").take(pa.array(take, pa.int64()))], ["block", "cells", "vec_id", "embedding"])

        vector = rows.schema["embedding"].dataType.simpleString()
        members = rows.mapInArrow(place, f"block long, cell long, vec_id long, embedding {vector}")
        sizes = F.broadcast(cut(members.groupBy("block").agg(F.ceil(F.count("*") / (4 * slice_rows)).cast("int").alias("slices"))))  # a row for each block of leaves: bounded by the sample
        members = members.join(sizes, "block").select("block", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice"), "cell", "vec_id", "embedding")
        queries = rows.where(is_query).mapInArrow(route, f"block long, cells array<long>, vec_id long, embedding {vector}").join(sizes, "block")
        queries = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("block", "slice", "cells", "vec_id", "embedding")

        def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return FOUND.empty_table()
            left = left.sort_by("cell")
            ids, m, cells, out = np.asarray(left["vec_id"]), _matrix(left["embedding"]), np.asarray(left["cell"]), []
            for i in range(0, len(right), 256):
                some = right.slice(i, 256)
                out += _best(ids, m, some["vec_id"].to_pylist(), _matrix(some["embedding"]), k, cells, some["cells"].to_pylist())
            return pa.Table.from_batches([_found(out)])

        found = members.groupBy("block", "slice").cogroup(queries.groupBy("block", "slice")).applyInArrow(score, "query_id long, vec_id long, score double")
        return keep(_ranked(found, k))
