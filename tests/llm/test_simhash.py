"""SimHash near duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import simhash
from loomspark.llm.common import Scratch

DIFFER = 4


def brute_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    parts = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """(id of each row's component by index) by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= DIFFER:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fp:016x}", least.get(r)) for (d, _), fp, r in zip(rows, fps, root, strict=True)), key=repr)


def test_digest_equals_brute_force(frame, corpus):
    df = frame(corpus)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in simhash.simhash_digest(df).collect()), key=repr)
    assert got == expected(docs)
    kept = simhash.without_simhash_duplicates(df)
    assert kept.columns == df.columns
    stays = sorted([d for d, _, c in expected(docs) if d is None or d == c], key=repr)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == stays


def test_empty_table(frame):
    assert simhash.simhash_digest(frame([])).count() == 0


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("differ", [1, 2, 4, 5])
def test_links_join_what_all_pairs_join(spark, differ, monkeypatch):
    """Groups around centres, chains and a dense group, with blocks so small that buckets are dealt out in tiles."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(differ)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for c in fps[:20]:
        fps += [flipped(rng, c, rng.randint(1, 9)) for _ in range(12)]
    chain = fps[20]
    for _ in range(30):
        chain = flipped(rng, chain, differ)
        fps.append(chain)
    centre = fps[21]
    fps += list({centre ^ sum(1 << rng.randrange(10) for _ in range(3)) for _ in range(120)})  # a few bits only
    fps = sorted(set(fps))
    points = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    with Scratch(spark) as cut:
        parts = simhash.plan(points, differ)
        assert sum(t for _, t in parts) - (differ + 1 - len(parts)) >= 0  # dropped partitions have threshold -1
        found = simhash.links(simhash.tiles(simhash.signatures(points, parts), cut), differ).collect()
    at = {int(np.uint64(x).astype(np.int64)): i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        i, j = at[r.a], at[r.b]
        root[find(i)] = find(j)
    got = {}
    for i in range(len(fps)):
        got.setdefault(find(i), set()).add(i)
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= differ:
            root[find(i)] = find(j)
    want = {}
    for i in range(len(fps)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(found) < 20 * len(fps)  # trees, not all pairs of the dense group


def test_thresholds_are_of_least_cost():
    rng = random.Random(3)
    for m, differ in itertools.product(range(2, 6), range(1, 5)):
        cost = [[0.0, *np.cumsum([rng.random() ** 3 for _ in range(differ + 1)])] for _ in range(m)]
        total = differ - m + 1
        if total < -m:
            continue
        got, t = simhash.allocated(cost, total)
        best = min(sum(c[x + 1] for c, x in zip(cost, ts, strict=True)) for ts in itertools.product(range(-1, differ + 1), repeat=m) if sum(ts) == total)
        assert sum(t) == total and got == pytest.approx(best) and got == pytest.approx(sum(c[x + 1] for c, x in zip(cost, t, strict=True)))


def test_distance_shares_equal_counting():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 32, 500) & rng.integers(0, 32, 500)
    want = np.bincount(np.bitwise_count(x[:, None] ^ x[None, :]).ravel(), minlength=6) / 500**2
    assert simhash.distances(np.bincount(x, minlength=32)) == pytest.approx(want)


def test_correlated_bits_are_grouped():
    c = np.zeros((8, 8))
    for pair in ((0, 5), (1, 6), (2, 7), (3, 4)):
        c[pair] = c[pair[::-1]] = 0.9
    assert sorted(map(tuple, simhash.grouped_bits(c, 4))) == [(0, 5), (1, 6), (2, 7), (3, 4)]
    assert sorted(b for p in simhash.grouped_bits(c, 3) for b in p) == list(range(8))


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("naïve café"))).first()[0] == int(np.uint64(xxhash.xxh64_intdigest("naïve café".encode(), 42)).astype(np.int64))
