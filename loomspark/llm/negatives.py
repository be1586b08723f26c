"""Hard negatives by cover trees over norm-augmented vectors (operator 13).

A vector x gets one more component, sqrt(M**2 - x.x) with M the greatest norm, so all lie on a sphere;
with 0 as an anchor's, the distance of both is M**2 + q.q - 2 q.x. So whatever bounds distances bounds inner products.

Rows are dealt to cells around a bounded number of pivots, each cell to slices of about ``slice_rows``,
and each slice gets one cover tree: the nodes of a level are centres further apart than
the level's radius, which halves from level to level; each keeps the covering radius of all
below it. A search goes through a tree best first: a node whose interval of inner products
misses what is asked for is skipped with all below it, and rows are verified in exact integers.
Cells are skipped by the same bound before anything is sent to them.

Three passes: an anchor's nearest cell gives a lower bound for its positives; the other cells that can
exceed it give the positives; those give the windows for negatives, which go to the cells that they meet.
Trees are built once and kept in a table. An anchor returns at most ``k`` rows from a slice.

Defined results: rows whose vec_id, label or vector is null, or with null or non-finite components (also
after scaling), take no part; vectors are compared with those of their length only; the other rows of
an anchor are those of another vec_id. Repeated rows are one; if one vec_id has several labels or
vectors, each is a candidate and an anchor of its own. Scores are exact up to the size of a long and
stop there. Windows are empty where the positive's score is negative. An empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, keep

LONG = 2**63 - 1
#: Relative allowance for rounding in bounds.
SLACK = 1e-9
#: A node of at most so many rows isn't divided; distances on the unit sphere below NEAR count as none.
LEAF, NEAR = 16, 1e-6


def exact(rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products, ``most`` being the rows' largest component: in doubles where these can't round, else in Python's integers."""
    if most * float(np.abs(q).max(initial=0)) * max(1, rows.shape[1]) < 2**53:
        return (rows @ q).astype(np.int64)
    whole = lambda x: np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return whole(rows) @ whole(q)


class Tree:
    """A cover tree of vectors on a sphere of radius ``norm`` in one more dimension.

    A node has a centre (a row), the radius that covers all its rows, the rows ``first`` to ``loose`` (of ``order``) that stand directly
    below it, and children, whose rows follow as far as ``last``. Children of at most LEAF rows are such rows, not nodes."""

    def __init__(self, rows: np.ndarray, norm: float):
        self.norm = norm
        scale = norm or 1.0
        x = rows / scale
        x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])
        order, nodes, self.children = [], [], []

        def away(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * (x @ centre)))

        def build(at: np.ndarray, centre: int, level: float) -> int:
            """A node of the rows ``at`` around the row ``centre``; its children's centres are over half of ``level`` apart."""
            own = x[at]
            gap = away(own, x[centre])
            reach = float(gap.max(initial=0))
            me, begin = len(nodes), len(order)
            nodes.append(None)
            self.children.append([])
            if len(at) <= LEAF or reach < NEAR:
                order.extend(at.tolist())
                nodes[me] = (centre, (reach + NEAR) * scale, begin, len(order), len(order))
                return me
            step, left, next_to, large = min(level, reach) / 2, np.ones(len(at), bool), centre, []
            while left.any():  # a net of the level: each centre takes what it covers
                gap = away(own, x[next_to])
                covered = left & (gap <= step)
                if not covered.any():
                    covered[left.argmax()] = True
                if covered.sum() > LEAF:
                    large.append((at[covered], next_to))
                else:
                    order.extend(at[covered].tolist())
                left &= ~covered
                next_to = int(at[np.where(left, gap, -1).argmax()])
            loose = len(order)
            self.children[me] = [build(rows, c, step) for rows, c in large]
            nodes[me] = (centre, (reach + NEAR) * scale, begin, loose, len(order))
            return me

        if len(rows):
            build(np.arange(len(rows)), int((x @ x.mean(axis=0)).argmax()), 2.0)
        self.order = np.array(order, np.int64)
        columns = list(zip(*nodes, strict=True)) or [()] * 5
        self.centre, self.radius, self.first, self.loose, self.last = (np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, np.int64), strict=True))
        self.children = [np.array(c, np.int64) for c in self.children]


def interval(inner: np.ndarray, radius: np.ndarray, norm: float, q_norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of what lies within ``radius`` of centres with these inner products."""
    sphere = norm * norm + q_norm * q_norm
    gap = np.sqrt(np.maximum(0, sphere - 2 * inner))
    slack = SLACK * (sphere + 1)
    return (sphere - (gap + radius) ** 2) / 2 - slack, (sphere - np.maximum(0, gap - radius) ** 2) / 2 + slack


def reaches(value: int) -> float:
    return SLACK * abs(float(value))


class Slice:
    """The rows of a slice with their tree, in the tree's order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, norm: float):
        self.tree = Tree(rows, norm)
        at = self.tree.order
        self.centres, self.most = rows[self.tree.centre], float(np.abs(rows).max(initial=0))
        self.ids, self.labels, self.rows = ids[at], labels[at], rows[at]

    def search(self, q: np.ndarray, k: int, wanted, low: int | None, high: int | None, seen: dict) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best rows with low <= score <= high (None: no bound) that are ``wanted(ids, labels)``,
        ties to smaller ids. ``seen`` keeps an anchor's inner products over its searches of this slice."""
        tree, best, queue = self.tree, [], []
        q_norm = float(np.sqrt((q * q).sum()))

        def push(nodes: np.ndarray) -> None:
            """Nodes whose interval meets the window, and may still hold one of the best."""
            key = int(nodes[0])
            if key not in seen:
                seen[key] = interval(self.centres[nodes] @ q, tree.radius[nodes], tree.norm, q_norm)
            least, most = seen[key]
            use = np.ones(len(nodes), bool)
            if low is not None:
                use &= most >= low - reaches(low)
            if high is not None:
                use &= least <= high + reaches(high)
                most = np.minimum(most, high + reaches(high))
            if len(best) == k:
                use &= most >= best[-1][0] - reaches(best[-1][0])
            for m, i in zip((-most[use]).tolist(), nodes[use].tolist(), strict=True):
                heapq.heappush(queue, (m, i))

        if len(self.rows):
            push(np.array([0]))
        while queue:
            most, node = heapq.heappop(queue)
            if len(best) == k and -most < best[-1][0] - reaches(best[-1][0]):
                break
            a, b = tree.first[node], tree.loose[node]
            if b > a:
                if ("rows", node) not in seen:
                    seen["rows", node] = exact(self.rows[a:b], q, self.most)
                score = seen["rows", node]
                good = wanted(self.ids[a:b], self.labels[a:b])
                floor = best[-1][0] if len(best) == k else low
                if floor is not None:
                    good &= (score >= (floor if low is None else max(low, floor))).astype(bool)
                if high is not None:
                    good &= (score <= high).astype(bool)
                some = np.flatnonzero(good)
                if len(some) > k:  # the k best of a leaf, and what ties with the last of them
                    last = -np.partition(-score[some], k - 1)[k - 1] if score.dtype != object else sorted(score[some])[-k]
                    some = some[(score[some] >= last).astype(bool)]
                best = sorted([*best, *((int(score[i]), int(self.ids[a + i])) for i in some)], key=lambda r: (-r[0], r[1]))[:k]
            if len(tree.children[node]):
                push(tree.children[node])
        return best


# ---------------------------------------------------------------- Spark


def valid_rows(table: DataFrame, relabel: Column | None = None, scale: int = 256) -> DataFrame:
    """(vec_id, label, dim, vec): rows that take part, components as whole numbers in doubles, repeated rows once."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if relabel is None else relabel).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  doubles from 2**52 on are whole
    rows = rows.withColumn("vec", F.transform("vec", lambda x: whole(x * scale)))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("vec_id", "label", F.size("vec").alias("dim"), "vec").distinct()


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 0))


class Pivots:
    """Centres of cells for each length of vectors in a sample, ``most`` in all: each next one is the row of the sample
    that is farthest from those before (of the length with most rows a centre)."""

    def __init__(self, vectors: list[np.ndarray], norm: float, most: int):
        self.norm, self.radius, self.centres = norm, {}, {}
        by: dict = {}
        for v in vectors:
            by.setdefault(len(v), []).append(v)
        for dim, rows in by.items():
            x = self.lifted(np.array(rows).reshape(len(rows), dim))
            at = [0]
            gap = np.full(len(x), np.inf)
            for _ in range(max(1, most * len(rows) // len(vectors)) - 1):
                gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(axis=1))
                if gap.max() <= 0:
                    break
                at.append(int(gap.argmax()))
            self.centres[dim] = x[at]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([rows, np.sqrt(np.maximum(0, self.norm**2 - (rows * rows).sum(axis=1)))])

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row (-1: none of that length), and how far it is."""
        centres = self.centres.get(rows.shape[1])
        if centres is None:
            return np.full(len(rows), -1), np.zeros(len(rows))
        x = self.lifted(rows)
        square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
        at = square.argmin(axis=1)
        return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1)) * (1 + SLACK)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, least, greatest inner product of their rows) for an anchor."""
        centres = self.centres.get(len(q))
        if centres is None:
            return np.array([-1]), np.array([-np.inf]), np.array([np.inf])
        cells = np.array([c for c in range(len(centres)) if (len(q), c) in self.radius], np.int64)
        radius = np.array([self.radius[len(q), int(c)] for c in cells])
        return cells, *interval(centres[cells, :-1] @ q, radius, self.norm, float(np.sqrt((q * q).sum())))


ASKED = "dim int, cell int, anchor long, vec_id long, label long, vec array<double>, tops array<long>"


def _route(pivots, choose):
    """Each anchor with the cells that ``choose(row, cells, least, greatest)`` picks."""

    def run(batches):
        for batch in batches:
            take, cells = [], []
            tops = batch.column("tops").to_pylist()
            for i, (q, t) in enumerate(zip(batch.column("vec"), tops, strict=True)):
                at = choose(t, *pivots.value.bounds(np.asarray(q.values, np.float64)))
                take += [i] * len(at)
                cells += at.tolist()
            some = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("dim"), pa.array(cells, pa.int32()), *(some.column(c) for c in ("anchor", "vec_id", "label", "vec", "tops"))], ["dim", "cell", "anchor", "vec_id", "label", "vec", "tops"])

    return run


FOUND = pa.schema([("anchor", pa.int64()), ("at", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _searched(trees: DataFrame, asked: DataFrame, search, cut: Scratch, block: int) -> DataFrame:
    """(anchor, at, score, id) that ``search(slice, q, vec_id, label, tops)`` yields for each anchor and slice of its cells.
    Anchors of a cell are dealt out in blocks of about ``block``, so no task gets all of a crowded one."""
    asked = cut(asked)
    blocks = cut(asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    slices = trees.join(blocks, ["dim", "cell"])
    copies = slices.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = asked.join(slices.select("dim", "cell", "blocks", "slice"), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("anchor"), F.col("blocks")).cast("int"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left["tree"].to_pylist():  # one
            one = pickle.loads(blob)
            for q, anchor, vec_id, label, tops in zip(_matrix(right["vec"]), *(right[c].to_pylist() for c in ("anchor", "vec_id", "label", "tops")), strict=True):
                out += [(anchor, at, max(-LONG - 1, min(LONG, score)), i) for at, score, i in search(one, q, vec_id, label, tops)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    key = ["dim", "cell", "slice", "block"]
    names = [f"tree_{c}" for c in key]
    left = copies.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), "tree").groupBy(*names)
    return left.cogroup(dealt.select(*key, "anchor", "vec_id", "label", "vec", "tops").groupBy(*key)).applyInArrow(run, "anchor long, at int, score long, id long")


def window(top: int, least: int, most: int) -> tuple[int, int]:
    """Integer scores s with least * top <= 100 * s <= most * top."""
    return -(-least * top // 100), most * top // 100


def hard_negatives(table: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, pivots: int = 1024, sample: int = 4096, slice_bytes: int = 2 << 20, block: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its inner product with an anchor, of components floor(scale * x). An anchor's positives are its first
    ``positives`` rows of the same label; each gets the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` percent
    of its own. ``pivots`` cells are placed by a ``sample`` of rows; all rows are indexed, and results are exact whatever the cells are.
    """
    spark = table.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Scratch(spark) as cut:
        rows = cut(valid_rows(table, relabel, scale))
        n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()
        if not n:
            return spark.createDataFrame([], empty)
        picked = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(sample).toArrow()  # at most ``sample`` rows
        width = max(1, picked["dim"].to_numpy().max(initial=1))
        shared = Pivots([np.asarray(v.values, np.float64) for v in picked["vec"]], norm * (1 + SLACK), int(max(1, min(pivots, n * width * 8 // (4 * slice_bytes)))))
        placing = spark.sparkContext.broadcast(shared)

        def place(batches):
            for batch in batches:
                dim = np.asarray(batch.column("dim"))
                cell, gap = np.zeros(len(dim), np.int32), np.zeros(len(dim))
                for d in np.unique(dim):
                    at = np.flatnonzero(dim == d)
                    cell[at], gap[at] = placing.value.cells(_matrix(batch.column("vec").take(pa.array(at))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

        placed = rows.mapInArrow(place, "vec_id long, label long, dim int, vec array<double>, cell int, gap double")
        sizes = cut(placed.groupBy("dim", "cell").agg(F.max("gap").alias("radius"), F.ceil(F.count("*") * F.greatest(F.first("dim"), F.lit(1)) * 8 / slice_bytes).cast("int").alias("slices")))
        shared.radius = {(r["dim"], r["cell"]): r["radius"] for r in sizes.where("cell >= 0").select("dim", "cell", "radius").toLocalIterator()}  # at most ``pivots`` rows, or one a length in the sample
        routing = spark.sparkContext.broadcast(shared)
        sliced = placed.join(sizes.select("dim", "cell", "slices"), ["dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))

        def plant(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
            one = Slice(np.asarray(members["vec_id"]), np.asarray(members["label"]), _matrix(members["vec"]), norm * (1 + SLACK))
            return pa.table([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([pickle.dumps(one)], pa.binary())], names=["dim", "cell", "slice", "tree"])

        trees = cut(sliced.groupBy("dim", "cell", "slice").applyInArrow(plant, "dim int, cell int, slice int, tree binary"))

        def best(one, q, vec_id, label, tops):
            found = one.search(q, positives, lambda ids, labels: (labels == label) & (ids != vec_id), tops[0] if tops else None, None, {})
            return [(0, *r) for r in found]

        def others(one, q, vec_id, label, tops):
            seen, out = {}, {}
            for at, top in enumerate(tops):
                if top not in out:
                    out[top] = one.search(q, negatives, lambda ids, labels: labels != label, *window(top, least, most), seen) if top >= 0 else []
                yield from ((at, *r) for r in out[top])

        def first(tops, cells, low, high):
            return cells[[high.argmax()]] if len(cells) else cells

        def rest(tops, cells, low, high):
            return cells[(np.arange(len(cells)) != high.argmax()) & ((high >= tops[0]) if tops else True)] if len(cells) else cells

        def meeting(tops, cells, low, high):
            windows = [window(t, least, most) for t in tops if t >= 0]
            return cells[(high >= min(w[0] for w in windows)) & (low <= max(w[1] for w in windows))] if windows else cells[:0]

        anchors = cut(rows.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "vec")))
        ask = lambda df, choose: df.select("dim", "anchor", "vec_id", "label", "vec", "tops").mapInArrow(_route(routing, choose), ASKED)
        by_score = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        top = lambda df: df.withColumn("at", F.row_number().over(by_score) - 1).where(F.col("at") < positives)
        at_home = cut(top(_searched(trees, ask(anchors.withColumn("tops", F.array().cast("array<long>")), first), best, cut, block)))
        bound = at_home.groupBy("anchor").agg(F.when(F.count("*") == positives, F.array(F.min("score"))).otherwise(F.array().cast("array<long>")).alias("tops"))
        bounded = anchors.join(bound, "anchor", "left").withColumn("tops", F.coalesce("tops", F.array().cast("array<long>")))
        further = _searched(trees, ask(bounded, rest), best, cut, block)
        chosen = cut(top(at_home.unionByName(further)).select("anchor", "at", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
        tops = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "positive_score"))).alias("p")).select("anchor", F.col("p.positive_score").alias("tops"))  # at most ``positives`` each
        found = _searched(trees, ask(anchors.join(tops, "anchor"), meeting), others, cut, block)
        order = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        named = ranked.join(chosen, ["anchor", "at"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        return keep(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
