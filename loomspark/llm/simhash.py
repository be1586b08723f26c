"""Near duplicates by SimHash fingerprints and the generalised pigeonhole principle (operator 11).

A fingerprint has 64 bits; a bit is set if over half of a document's shingle hashes have it set.
Fingerprints of at most ``differ`` unlike bits are linked. Their bits are grouped into m
partitions, and each partition i gets a threshold t(i) of -1 (not looked at) or more, so that the
thresholds sum to differ - m + 1: two fingerprints whose partitions all differ in more than t(i)
bits differ in more than ``differ`` bits. Candidates are therefore pairs with some partition
within its threshold, and none is missed whatever the grouping and the thresholds are. Both
follow from all fingerprints:

* bits that go together are grouped, so that what they share weighs on one partition only
  (correlations from one pass that returns 64 x 64 sums);
* the number of pairs within t bits of a partition is estimated from histograms of slices of it
  of at most 11 bits, whose distances are convolved (one pass, a fixed number of counts);
* dynamic programming over partitions finds the thresholds of least cost (rows to shuffle and
  pairs to compare) for each m, and the cheapest m is taken.

Each distinct fingerprint is at home in one bucket a partition (its bits there) and visits the
buckets of smaller values within the threshold. Fingerprints of a bucket are verified by
breadth-first search over what has not been reached: a dense group costs little more than one
pass and yields a tree of links, never all pairs. A bucket of very many is dealt out in tiles of
two blocks, so no task holds one of any size.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows
without doc_id link others and get the component's id, which is null if no row of it has one;
rows of one doc_id count each; other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, Words, chunks, components, gathered, give_back, keep, roots_of

BITS = 64
#: Bits of a slice whose values are counted.
SLICE = 11
#: Fingerprints of a block of a bucket, at least and at most.
BLOCK, MOST = 4096, 65536
#: Pairs compared in the time that one shuffled row takes.
PAIRS_A_ROW = 50


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(texts: pa.Array, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles (``size`` words, repeats included, joined by one space), and each row's first one (one more entry than rows)."""
    words = Words(texts, lower=True)
    length = words.end - words.start
    to = np.cumsum(length + 1) - length - 1  # where each word begins if one space follows every word
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
    joined[np.repeat(to, length) + place] = words.data[np.repeat(words.start, length) + place]
    n = np.diff(words.first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.r_[0, np.cumsum(many)]
    begin = np.arange(first[-1]) - np.repeat(first[:-1], many) + np.repeat(words.first[:-1], many)
    last = begin + np.repeat(np.minimum(n, size), many) - 1
    data, digest = memoryview(joined), xxhash.xxh64_intdigest
    each = (digest(data[a:b], seed) for a, b in zip(to[begin].tolist(), (to[last] + length[last]).tolist(), strict=True))
    return np.fromiter(each, np.uint64, len(begin)), first


def fingerprints(texts: pa.Array, size: int = 4, step: int = 1 << 16) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    h, first = shingle_hashes(texts, size)
    counts = np.zeros((len(first) - 1, BITS), np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, len(h), step):
        bits = np.unpackbits(h[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.diff(owner[a : a + step], prepend=-1))
        counts[owner[a : a + step][begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    above = 2 * counts > np.diff(first)[:, None]
    return np.packbits(above, axis=1, bitorder="little").view(np.uint64).ravel()


def simhashes(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches):
        for table in chunks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(fingerprints(table["text"], size).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- partitions and thresholds


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits, of about equal size: each begins with the bit that goes with others most
    and takes in what goes with its own bits most."""
    left, out = set(range(len(correlation))), []
    for i in range(m):
        rest = sorted(left)
        part = [max(rest, key=lambda b: (correlation[b, rest].sum(), -b))]
        left.remove(part[0])
        for _ in range(len(rest) // (m - i) - 1):
            part.append(max(sorted(left), key=lambda b: (correlation[b, part].sum(), -b)))  # noqa: B023
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition, next to each other."""
    out = np.zeros(len(fp), np.uint64)
    for to, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(to)
    return out


def distances(counts: np.ndarray) -> np.ndarray:
    """Share of pairs at each distance from the counts of all values of a slice (an autocorrelation, by Walsh-Hadamard transforms)."""
    x = counts.astype(np.float64) / max(counts.sum(), 1)
    size = len(x)

    def transform(x):
        step = 1
        while step < size:
            x = x.reshape(-1, 2, step)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
            step *= 2
        return x

    pairs = transform(transform(x) ** 2) / size
    return np.bincount(np.bitwise_count(np.arange(size)), pairs, size.bit_length())


def slices(part: list[int]) -> list[list[int]]:
    return [list(map(int, s)) for s in np.array_split(part, -(-len(part) // SLICE))]


def allocated(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least cost, and thresholds that sum to ``total``, of which partition i costs ``cost[i][t + 1]`` at threshold t."""
    best = {0: (0.0, [])}
    for of in cost:
        step: dict = {}
        for spent, (c, chosen) in best.items():
            for t, more in enumerate(of, -1):
                if spent + t not in step or c + more < step[spent + t][0]:
                    step[spent + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def ball(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def plan(points: DataFrame, differ: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, from (fp) of all distinct fingerprints."""

    def together(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for table in gathered(batches, 1 << 16):
            fp = np.asarray(table["fp"].combine_chunks()).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["bit", "with"])

    each = [F.sum(F.col("with")[i]).alias(f"s{i}") for i in range(BITS)]
    rows = {r[0]: r[1:] for r in points.mapInArrow(together, "bit int, with array<long>").groupBy("bit").agg(*each).collect()}  # BITS rows
    both = np.array([rows[b] for b in range(BITS)], np.float64)
    n = points.count()
    ones = np.diag(both) / n
    covariance = both / n - np.outer(ones, ones)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    correlation = np.abs(covariance) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(correlation, 0)

    choices = [grouped_bits(correlation, m) for m in range(2, differ + 2)]
    cells = [s for parts in choices for part in parts for s in slices(part)]

    def count(batches):
        total = [np.zeros(2 ** len(s), np.int64) for s in cells]
        for table in gathered(batches, 1 << 16):
            fp = np.asarray(table["fp"].combine_chunks()).view(np.uint64)
            for t, s in zip(total, cells, strict=True):
                t += np.bincount(values(fp, s).astype(np.int64), minlength=len(t))
        for k, t in enumerate(total):
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(t[some])], ["slice", "value", "n"])

    counted = points.mapInArrow(count, "slice long, value long, n long").groupBy("slice", "value").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most 2**SLICE rows for each of a fixed number of slices
    of = [np.zeros(2 ** len(s), np.int64) for s in cells]
    for k in range(len(cells)):
        mine = np.asarray(found["slice"]) == k
        of[k][np.asarray(found["value"])[mine]] = np.asarray(found["n"])[mine]

    best, k = None, 0
    for parts in choices:
        cost = []
        for part in parts:
            share = np.ones(1)
            for _ in slices(part):
                share, k = np.convolve(share, distances(of[k])), k + 1
            share = np.cumsum(share)
            cost.append([0.0] + [n * (ball(len(part), t) + 1) / 2 + n * n * share[min(t, len(part))] / 2 / PAIRS_A_ROW for t in range(differ + 1)])
        found = allocated(cost, differ - len(parts) + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [(p, t) for p, t in zip(parts, found[1], strict=True) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- buckets and verification


def signatures(points: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, home): the buckets of each fingerprint. A visitor goes to smaller values only, so a pair meets once a partition."""
    masks = [np.array([sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(range(len(bits)), k)], np.uint64) for bits, t in parts]

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for i in range(0, len(fp), 4096):
                some = fp[i : i + 4096]
                for k, ((bits, _), mask) in enumerate(zip(parts, masks, strict=True)):
                    own, top = values(some, bits), np.uint64(k << 56)
                    to = own[:, None] ^ mask
                    row, col = np.nonzero(to < own[:, None])
                    key = np.concatenate([own, to[row, col]]) | top
                    who = np.concatenate([some, some[row]])
                    home = np.arange(len(key)) < len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who.view(np.int64)), pa.array(home)], ["key", "fp", "home"])

    return points.mapInArrow(run, "key long, fp long, home boolean")


def tiles(rows: DataFrame, cut: Scratch) -> DataFrame:
    """(homes, visitors, own): blocks of a bucket to compare with each other, and (``own``) the homes with themselves.
    Buckets of over BLOCK homes or visitors are dealt out: every home block meets itself, each later one, and each block of visitors."""
    blocks = lambda n: F.ceil(F.col(n) / F.least(F.greatest(F.col(n) / 32, F.lit(BLOCK)), F.lit(MOST))).cast("int")
    tally = rows.groupBy("key").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    large = cut(tally.where((F.col("h") > 0) & ((F.col("h") > BLOCK) | (F.col("v") > BLOCK))).select("key", F.greatest(blocks("h"), F.lit(1)).alias("hb"), blocks("v").alias("vb")))
    hashed = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    span = lambda a, b, f: F.when(F.lit(a) <= b, F.transform(F.sequence(F.lit(a), b), f)).otherwise(F.array())
    tile = lambda i, j, own, left: F.struct(F.lit(i).cast("int").alias("i"), F.lit(j).cast("int").alias("j"), F.lit(own).alias("own"), F.lit(left).alias("left"))
    b = hashed("hb")
    at_home = F.concat(
        F.array(tile(b, b, True, True)),
        F.filter(span(0, F.col("hb") - 1, lambda j: F.when(b < j, tile(b, j, False, True)).when(b > j, tile(j, b, False, False))), lambda t: t.isNotNull()),
        span(0, F.col("vb") - 1, lambda j: tile(b, F.col("hb") + j, False, True)),
    )
    visiting = span(0, F.col("hb") - 1, lambda i: tile(i, F.col("hb") + hashed("vb"), False, False))
    dealt = rows.join(large, "key", "left").withColumn("tile", F.explode(F.when(F.col("hb").isNull(), F.array(tile(0, 0, True, F.col("home")))).when(F.col("home"), at_home).otherwise(visiting)))
    grouped = dealt.groupBy("key", "tile.i", "tile.j", "tile.own")  # at most a block, or two, of each
    lists = grouped.agg(F.collect_list(F.when(F.col("tile.left"), F.col("fp"))).alias("homes"), F.collect_list(F.when(~F.col("tile.left"), F.col("fp"))).alias("visitors"))
    return lists.where((F.size("homes") > 0) & (F.size("homes") + F.size("visitors") > 1)).select("homes", "visitors", "own")


def reached(homes: np.ndarray, visitors: np.ndarray, own: bool, differ: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Trees of links (a, b) that join what is joined: homes with visitors and, if ``own``, with homes. Breadth first: a
    fingerprint is compared with those that nothing has reached yet."""
    left, right, a, b = homes, visitors, [], []
    while len(left):
        ahead, left = [(left[0], True)], left[1:]
        while ahead and (len(left) or len(right)):
            x, is_home = ahead.pop()
            if is_home and len(right):
                near = np.bitwise_count(right ^ x) <= differ
                if near.any():
                    ahead += [(y, False) for y in right[near]]
                    b.append(right[near])
                    a.append(np.full(len(b[-1]), x))
                    right = right[~near]
            if (own or not is_home) and len(left):
                near = np.bitwise_count(left ^ x) <= differ
                if near.any():
                    ahead += [(y, True) for y in left[near]]
                    b.append(left[near])
                    a.append(np.full(len(b[-1]), x))
                    left = left[~near]
    return a, b


def links(buckets: DataFrame, differ: int, small: int = 64) -> DataFrame:
    """(a, b): verified links that join what is joined in each bucket of ``tiles``."""

    def run(batches):
        for batch in batches:
            homes, visitors = batch.column("homes"), batch.column("visitors")
            hf, vf = (np.asarray(c.flatten()).view(np.uint64) for c in (homes, visitors))
            hn, vn = (np.asarray(pc.list_value_length(c)).astype(np.int64) for c in (homes, visitors))
            h0, v0, own = np.cumsum(hn) - hn, np.cumsum(vn) - vn, np.asarray(batch.column("own"))
            few = (hn + vn) <= small
            a, b = [], []
            at = np.flatnonzero(few)
            for s in np.split(at, np.flatnonzero(np.diff(np.cumsum(hn[at] * (hn + vn)[at]) >> 20)) + 1):  # small buckets side by side, about a million pairs at once
                wide = hn[s] + vn[s]
                of = np.repeat(np.arange(len(s)), hn[s] * wide)
                k = np.arange(len(of)) - np.repeat(np.cumsum(hn[s] * wide) - hn[s] * wide, hn[s] * wide)
                i, j = k // wide[of], k % wide[of]
                use = (j >= hn[s][of]) | own[s][of] & (i < j)
                of, i, j = of[use], i[use], j[use]
                x = hf[h0[s][of] + i]
                inner = j < hn[s][of]
                y = np.empty(len(x), np.uint64)
                y[inner] = hf[(h0[s][of] + j)[inner]]
                y[~inner] = vf[(v0[s][of] + j - hn[s][of])[~inner]]
                near = np.bitwise_count(x ^ y) <= differ
                a.append(x[near])
                b.append(y[near])
            for s in np.flatnonzero(~few):
                more = reached(hf[h0[s] : h0[s] + hn[s]], vf[v0[s] : v0[s] + vn[s]], bool(own[s]), differ)
                a += more[0]
                b += more[1]
            u, v = (np.concatenate(x).astype(np.uint64) if x else np.zeros(0, np.uint64) for x in (a, b))
            names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = roots_of(ends[: len(u)], ends[len(u) :], len(names))
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(names[tied].view(np.int64)), pa.array(names[root[tied]].view(np.int64))], ["a", "b"])
        give_back()

    return buckets.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, size: int = 4, differ: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): ``component_id`` is the smallest doc_id reachable over links."""
    spark = docs.sparkSession
    with Scratch(spark) as cut:
        rows = cut(simhashes(docs, size))
        points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
        if points.isEmpty():
            return spark.createDataFrame([], "doc_id long, fp long, component_id long")
        only = points.select("fp")
        linked = components(cut(links(tiles(signatures(only, plan(only, differ)), cut), differ).distinct()))
        named = cut(points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        least = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # written: a root of very many can then be split in the join
        named = cut(named.join(least, "root").select("fp", "component_id"))
        return keep(rows.join(named, "fp").select("doc_id", "fp", "component_id"))


def simhash_digest(docs: DataFrame, size: int = 4, differ: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 hexadecimal digits."""
    found = simhash_groups(docs, size, differ)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_simhash_duplicates(docs: DataFrame, size: int = 4, differ: int = 4) -> DataFrame:
    """``docs``, all columns, with the rows of the smallest doc_id of each component; rows without an id stay."""
    gone = simhash_groups(docs, size, differ).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.withColumn("__id", F.col("doc_id").cast("long")).join(gone, "__id", "left_anti").drop("__id")
