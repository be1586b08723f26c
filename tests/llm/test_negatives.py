"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, cell string, tree string, at string"


def brute(rows, positives=5, count=3):
    real = []
    for i, v, label in sorted({(i, None if v is None else tuple(v), label) for i, v, label in rows}, key=repr):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        real.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    for a, q, label in real:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, v, l in real if i != a and len(v) == len(q))
        for p, positive, _ in [r for r in scored if r[2] == label][:positives]:
            hits = [r for r in scored if r[2] != label and 50 * -p <= 100 * -r[0] <= 95 * -p]
            for rank, (s, i, _) in enumerate(hits[:count], 1):
                yield a, positive, rank, i, -p, -s


def found(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, relabel, **settings).collect())


def clustered(n, d, centres, spread, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d))
    x = c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))
    return [(i, (scale * v / np.linalg.norm(v) * rng.uniform(0.5, 1)).tolist(), int(rng.integers(0, 10))) for i, v in enumerate(x)]


@pytest.mark.parametrize("settings", [{}, {"slice_bytes": 1 << 12, "block": 2, "sample": 200}])
def test_negatives_equal_brute_force(spark, settings):
    rows = clustered(700, 8, 6, 0.3, 1)
    rows += [(1000, [0.5] * 8, 1), (1001, [0.5] * 8, 1), (1050, [0.5] * 8, 1), (1002, [0.48] * 8, 2), (1003, [0.48] * 8, 3), (1002, [0.48] * 8, 2)]  # ties and a repeated row
    rows += [(1100, None, 1), (1150, [1.0] * 8, None), (1200, [None] + [1.0] * 7, 1), (1250, [float("nan")] + [1.0] * 7, 1), (1300, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    rows += [(1400, [0.3, 0.4], 1), (1401, [0.3, 0.4], 1), (1402, [0.25, 0.4], 2), (1450, [], 1), (1451, [], 1), (1452, [], 2), (1500, [0.0] * 8, 4)]
    got = found(spark, rows, **settings)
    assert got == sorted(brute(rows))
    assert len(got) > 100


def test_empty_tables_and_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    assert found(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 2), (2, [1.0, 0.1], 1), (3, [0.6, 0.0], 2)]) == [(0, 2, 1, 3, 256 * 256, 256 * 153)]


def test_products_beyond_doubles_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(2**19, 2**20)) + rng.random() for _ in range(6)], i % 3) for i in range(120)]
    assert found(spark, rows) == sorted(brute(rows))


def test_one_vector_holds_a_third_of_all_rows(spark):
    rows = clustered(400, 6, 4, 0.2, 5) + [(400 + i, [0.9, 0.1, 0.0, 0.2, 0.3, 0.1], i % 4) for i in range(200)]
    assert found(spark, rows, slice_bytes=1 << 12, block=4) == sorted(brute(rows))


def test_tree_covers_its_rows():
    """Every node's radius covers all rows below it in the lifted space, and every row stands below one node once."""
    rows = np.floor(256 * np.array([r[1] for r in clustered(3000, 12, 40, 0.05, 2)]))
    norm = float(np.sqrt((rows * rows).sum(axis=1)).max())
    tree = negatives.Tree(rows, norm)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    lifted = np.column_stack([rows, np.sqrt(np.maximum(0, norm**2 - (rows * rows).sum(axis=1)))])
    assert len(tree.centre) > 20 and max(tree.loose - tree.first) < 200
    for c, r, a, b in zip(tree.centre, tree.radius, tree.first, tree.last, strict=True):
        assert np.sqrt(((lifted[tree.order[a:b]] - lifted[c]) ** 2).sum(axis=1)).max() <= r * (1 + 1e-6)


def test_search_skips_most_of_clustered_rows():
    rows = np.floor(256 * np.array([r[1] for r in clustered(6000, 12, 60, 0.03, 4)]))
    labels = np.arange(len(rows)) % 10
    one = negatives.Slice(np.arange(len(rows)), labels, rows, float(np.sqrt((rows * rows).sum(axis=1)).max()))
    touched = []
    for i in range(0, 600, 6):
        q, seen = rows[i], {}
        best = one.search(q, 5, lambda ids, own: (own == 3) & (ids != i), None, None, seen)  # noqa: B023
        score = (rows @ q).astype(int)
        want = sorted((-score[j], j) for j in np.flatnonzero(labels == 3) if j != i)[:5]
        assert [(-s, j) for s, j in best] == [(int(a), int(b)) for a, b in want]
        touched.append(sum(len(v) for k, v in seen.items() if isinstance(k, tuple) and k[0] == "rows"))
    assert np.mean(touched) < 0.3 * len(rows)
