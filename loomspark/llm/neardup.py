"""Near-duplicate documents by a chosen-path similarity join (operator 6).

Documents are sets of word shingles; equal sets collapse to one class first. Each
class has a signature of ``COORDINATES`` minwise tokens. A tree's node picks two
coordinates from its own path, and every class in the node goes on to the two
children named by its minwise tokens there. A pair of similarity 0.8 shares a child
of each shared node with a chance of 0.96, and a leaf of a tree of any depth with
0.93 at least, so ``trees`` independent trees lose about 0.07 ** trees of such pairs (1e-6 for
five), whatever the other documents are. Nodes of at most ``leaf`` classes are leaves: their
classes are compared exhaustively by their signatures; the pairs that may be similar
(at least 56 % of the coordinates agree, which a pair of 0.8 misses with a chance of
1e-6) give the edges of a spanning forest of the node. From level
``levels`` on, nodes of up to WIDE classes are compared exhaustively too: they hold groups of near
copies, which no further level would part (it would only multiply them), and texts that happen to
share a few frequent tokens, which must not be tied to each other. Only nodes over WIDE
go DEEPER; what is still larger then is tied to its smallest class and compared below.

Connected components of these edges are the candidate groups. In each group the full
sets are compared, and only pairs with ``100 * common >= percent * union`` are linked: a
class that is linked already to a component isn't compared to the rest of it. A group
whose sets exceed ``groups.GROUP_BYTES`` is worked through in chunks, and then what is outside
its largest component goes past every chunk, tile by tile, so that no link is lost and no
task holds a group of any size.

Defined results: null and empty texts have no shingles and are linked with nothing;
texts of fewer words than a shingle are one shingle of all their words; rows with
a null ``doc_id`` are linked with nothing and kept; repeated rows and equal ids are
classes by their sets alone; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, Words, chained, chunks, components, keep, mix
from .groups import PACKED, dealt, link_groups

COORDINATES = 64
AGREE = 36
#: A class that agrees so well with one that was compared to all others needn't be: what it may be similar to is tied to that one, by a bound so much lower.
CLOSE = 56
#: Classes of a node that are compared in one task (4 MB of signatures), and levels that larger nodes go on.
WIDE, DEEPER = 1 << 14, 3
#: Words of 64 bits in the bitmap of wanted documents: the bound of its broadcast (some 10 MB), whatever the input.
WORDS_OF_BITS = 1 << 18
_A = np.random.default_rng(6).integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SIZE_SEED = np.uint64(0x5851F42D4C957F2D)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and where each text begins."""
    words = Words(texts, lower=True)
    h, count = words.hashes(60_001), np.diff(words.first)
    at = np.arange(max(0, len(h) - size + 1))
    at = at[words.doc[at] == words.doc[at + size - 1]] if len(at) else at
    short = np.flatnonzero((count > 0) & (count < size))
    begin = np.concatenate([at, words.first[short]])
    doc = words.doc[begin] if len(begin) else np.zeros(0, np.int64)
    x = chained(h, begin, np.concatenate([np.full(len(at), size), count[short]]), 60_002)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])] if len(x) else np.zeros(0, bool)
    return x[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _set_keys(x: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; null for an empty one."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ s))]) for s in (_SIZE_SEED, ~_SIZE_SEED)]
    n = np.diff(first).astype(np.uint64)
    a, b = (mix((s[first[1:]] - s[first[:-1]]) + n) for s in sums)
    return [None if k == 0 else i.tobytes() + j.tobytes() for k, i, j in zip(n.tolist(), a, b, strict=True)]


def _signatures(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minwise tokens of 31 bits; zeros for empty sets."""
    out = np.zeros((len(first) - 1, COORDINATES), np.int32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for i, a in enumerate(_A):
            y = x * a
            y ^= y >> np.uint64(32)
            out[full, i] = (np.minimum.reduceat(y * a, first[full]) >> np.uint64(33)).astype(np.int32)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, n, cls, sig): ``h`` hashes the text; number of shingles, the set's name, its signature."""

    def run(batches):
        for table in chunks(batches, 2 << 20):
            x, first = shingles(table["text"], size)
            sig = _signatures(x, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES), pa.array(sig.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["h"].combine_chunks(), pa.array(np.diff(first), pa.int64()), pa.array(_set_keys(x, first), pa.binary()), lists], ["doc_id", "h", "n", "cls", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, cls binary, sig array<int>")


def near_forest(m: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges between rows of signatures whose components hold every pair that agrees in AGREE coordinates."""
    a, b = [], []
    root, at = np.arange(len(m)), np.arange(len(m))
    while len(at) > 1:
        i, at, first, m = at[0], at[1:], m[0], m[1:]
        agree = (m == first).sum(axis=1)
        close = agree >= CLOSE
        near = at[agree >= (AGREE - (COORDINATES - CLOSE) if close.any() else AGREE)]
        found, where = np.unique(root[near], return_index=True)
        new = found != root[i]
        if new.any():
            a += [int(i)] * int(new.sum())
            b += near[where[new]].tolist()
            found = np.r_[found[new], root[i]]
            root[np.isin(root, found)] = found.min()
        if close.any():
            at, m = at[~close], m[~close]
    return a, b


def _leaf_edges(batches):
    """Edges of a spanning forest of each leaf's classes that may be similar."""
    for batch in batches:
        a, b = [], []
        sigs = batch.column("sigs")
        for row, names in enumerate(batch.column("names").to_pylist()):
            m = np.asarray(sigs[row].values.flatten()).reshape(len(names), COORDINATES)
            order = sorted(range(len(names)), key=names.__getitem__)
            for i, j in zip(*near_forest(m[order]), strict=True):
                a.append(names[order[j]])
                b.append(names[order[i]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def candidate_edges(classes: DataFrame, trees: int, leaf: int, levels: int, cut: Scratch) -> DataFrame:
    """(a, b) edges whose components hold every similar pair that shares a node, from (cls, sig)."""

    def step(nodes: DataFrame) -> DataFrame:
        """Each class goes on to two children of its node."""
        moved = nodes.select("cls", "sig", "path", F.explode(F.array(F.lit(0), F.lit(1))).alias("branch"))
        moved = moved.withColumn("at", F.pmod(F.xxhash64("path", "branch"), F.lit(COORDINATES)).cast("int"))
        return moved.select("cls", F.xxhash64("path", "at", F.element_at("sig", F.col("at") + 1)).alias("path"))

    nodes = classes.select("cls", "sig", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trees).cast("long"))).alias("path"))
    edges = None
    for level in range(1, levels + DEEPER + 1):
        most = leaf if level < levels else max(leaf, WIDE)
        children = step(nodes)
        held = cut(children.groupBy("path").agg(F.count("*").alias("n"), F.min("cls").alias("least")).where("n > 1"))
        small = children.join(held.where(F.col("n") <= most).select("path"), "path").join(classes, "cls")
        grouped = small.groupBy("path").agg(F.collect_list("cls").alias("names"), F.collect_list("sig").alias("sigs")).select("names", "sigs")  # at most ``most`` of each
        found = grouped.mapInArrow(_leaf_edges, "a binary, b binary")
        edges = found if edges is None else edges.unionByName(found)
        large = held.where(F.col("n") > most).select("path", "least")
        if large.isEmpty():
            return edges
        nodes = children.join(large, "path")
        if level == levels + DEEPER:
            return edges.unionByName(nodes.where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")))
        nodes = cut(nodes.join(classes, "cls").select("cls", "sig", "path"))
    return edges


class Linker:
    """Exact components of sets met one after the other. Sets that may be linked share a
    token of their prefixes (the first tokens in an order of all, as many as the threshold lets differ, and
    one), so only components with such a set are looked at."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[frozenset] = []
        self.root: list[int] = []
        self.members: dict[int, list[int]] = {}
        self.index: dict[int, set[int]] = {}

    def linked(self, x: frozenset, y: frozenset) -> bool:
        if self.percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
            return False
        common = len(x & y)
        return 100 * common >= self.percent * (len(x) + len(y) - common)

    def add(self, tokens: list[int]) -> None:
        """``tokens`` ascending."""
        i, item = len(self.sets), frozenset(tokens)
        self.sets.append(item)
        self.root.append(i)
        self.members[i] = [i]
        near: set[int] = set()
        prefix = tokens[: len(tokens) + self.percent * len(tokens) // -100 + 1]
        for t in prefix:
            if t in self.index:
                self.index[t] = {self.root[j] for j in self.index[t]}
                near |= self.index[t]
        for c in near:
            mine = self.members[c]
            for at, j in enumerate(mine):
                if self.linked(item, self.sets[j]):
                    mine[0], mine[at] = mine[at], mine[0]  # what has linked once is asked first
                    self.join(i, j)
                    break
        for t in prefix:
            self.index.setdefault(t, set()).add(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            for k in self.members[b]:
                self.root[k] = a
            self.members[a] += self.members.pop(b)


def _pack_sets(size: int):
    def run(batches):
        for table in chunks(batches, 2 << 20):
            x, first = shingles(table["text"], size)
            keys = _set_keys(x, first)
            right = [i for i, (k, want) in enumerate(zip(keys, table["cls"].to_pylist(), strict=True)) if k == want]
            sets = [x[first[i] : first[i + 1]].tobytes() for i in right]
            take = pa.array(right, pa.int64())
            yield pa.RecordBatch.from_arrays([table[c].combine_chunks().take(take) for c in ("cls", "grp", "part")] + [pa.array(sets, pa.binary())], ["cls", "grp", "part", "items"])

    return run


def _link_sets(percent: int):
    def link(items: list[bytes]) -> list[int]:
        linker = Linker(percent)
        first = np.cumsum([0, *(len(x) // 8 for x in items)])
        _, token, count = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # the rarest first, so that few prefixes meet
        token = rank[token]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            linker.add(np.sort(token[i:j]).tolist())
        return linker.root

    return link


def _perhaps_wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, ...) without most rows whose doc_id isn't in ``ids``: those whose hash has no bit in a bitmap of a
    fixed size. No row of ``ids`` is lost; the join that follows is exact. With more ids the bitmap fills and keeps more."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(WORDS_OF_BITS * 64))
    place = [F.shiftright(slot, 6).alias("__word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("__bit")]
    words = ids.select(*place).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    found = docs.select("*", *place).join(F.broadcast(words), "__word").where(F.getbit("__bits", "__bit") == 1)  # at most WORDS_OF_BITS rows
    return found.select(*docs.columns)


def linked_classes(docs: DataFrame, groups: DataFrame, size: int, percent: int, cut: Scratch) -> DataFrame:
    """(node, root) of classes linked with others. ``groups``: (cls, grp, doc_id, n) of the
    candidate groups, one document for each class."""
    wanted, oversized = dealt(groups.withColumn("bytes", F.col("n") * 8), cut)
    texts = _perhaps_wanted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), groups.select("doc_id"))
    sets = texts.join(wanted.select("doc_id", "cls", "grp", "part"), "doc_id")
    packed = sets.select("cls", "grp", "part", "text").mapInArrow(_pack_sets(size), PACKED)
    return link_groups(packed, oversized, _link_sets(percent), cut)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = 5, leaf: int = 48, levels: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, h, cls): ``component_id`` is the smallest doc_id reachable over links."""
    with Scratch(docs.sparkSession) as cut:
        rows = cut(sketches(docs, size))
        whole = rows.where("cls is not null and doc_id is not null")
        classes = cut(whole.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
        edges = cut(candidate_edges(classes.select("cls", "sig"), trees, leaf, levels, cut).distinct())
        groups = components(edges)
        groups = classes.join(groups.withColumnRenamed("node", "cls").withColumnRenamed("root", "grp"), "cls").select("cls", "grp", "doc_id", "n")
        links = linked_classes(docs, cut(groups), size, percent, cut)
        named = cut(classes.select("cls", "doc_id").join(links.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        least = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # written: a root of very many classes can then be split in the join
        named = cut(named.join(least, "root").select("cls", "component_id"))
        full = whole.select("doc_id", "h", "n", "cls").join(named, "cls")
        empty = rows.where("cls is null or doc_id is null").select("doc_id", "h", "n", "cls", F.col("doc_id").alias("component_id"))
        out = full.select("doc_id", "h", "n", "cls", "component_id").unionByName(empty)
        return keep(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h", "cls"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one of smallest id. Of rows
    equal in id and text one stays, that of the least hash of all its columns. Rows without an id stay."""
    found = near_duplicates(docs, size, percent).where("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "kept")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__h", F.xxhash64("text"))
    out = keyed.join(found.where("not kept").select("__id", "__h").distinct(), ["__id", "__h"], "left_anti")
    twice = keep(found.where("kept").groupBy("__id", "__h").count().where("count > 1").select("__id", "__h"))
    if not twice.isEmpty():
        order = Window.partitionBy("__id", "__h").orderBy(F.xxhash64(*docs.columns))
        one = out.join(twice, ["__id", "__h"], "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
        out = out.join(twice, ["__id", "__h"], "left_anti").unionByName(one)
    return out.drop("__id", "__h")
