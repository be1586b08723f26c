"""Upkeep of similar pairs equals a full run."""

import random

import pytest

from loomspark.operators import retrieval as rt, similarity as sm


def frame(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")


def found(df):
    return sorted((r.a, r.b, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("per_row", [2, 50])
def test_changes_equal_a_full_run(spark, per_row):
    rng = random.Random(per_row)
    draw = lambda: [rng.gauss(0, 1) for _ in range(4)]
    old = {i: draw() for i in range(80)}
    stored = rt.similar_pairs(frame(spark, old), 0.6, per_row, block_rows=32)
    now = {i: v for i, v in old.items() if i not in (3, 4, 5)} | {i: draw() for i in (10, 11, 80, 81, 82)}
    changed = spark.createDataFrame([(i,) for i in (3, 4, 5, 10, 11, 80, 81, 82)], "vec_id long")
    got = sm.updated_pairs(stored, frame(spark, now), changed, 0.6, per_row, block_rows=16)
    assert found(got) == found(rt.similar_pairs(frame(spark, now), 0.6, per_row, block_rows=32))


def test_pairs_of_odd_vectors(spark):
    df = frame(spark, {1: [1.0, 0.0], 2: [2.0, 0.0], 3: [1.0], 4: [3.0], 5: None, 6: [], 7: [0.0, 0.0]})
    assert found(sm.pairs_with(df, df, 0.5)) == [(1, 2, 1.0), (3, 4, 1.0)]
    assert found(sm.pairs_with(df.limit(0), df, 0.5)) == []
    assert found(sm.updated_pairs(sm.pairs_with(df, df, 0.5), df, df.limit(0).select("vec_id"), 0.5, 5)) == [(1, 2, 1.0), (3, 4, 1.0)]
