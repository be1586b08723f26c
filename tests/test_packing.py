"""Parallel packing against filling batches one row after the other."""

from __future__ import annotations

import random

import pytest

from loomspark.functions.python import pack
from loomspark.operators import packing


@pytest.mark.parametrize(("ranges", "drop"), [(1, True), (7, True), (7, False), (40, False)])
def test_batches_equal_those_filled_in_order(spark, ranges, drop):
    rng = random.Random(ranges)
    rows = [("hot", i, rng.choice([0, 1, 3, 3, 9, 20, 31])) for i in range(-40, 260)] + [(k, i, rng.randint(0, 30)) for k in ("a", None) for i in range(15)] + [("one", 5, 0), ("large", 1, 99), ("large", 2, 99), ("null", 1, None), ("null", 2, 30)]
    shuffled = rng.sample(rows, len(rows))
    got = packing.pack_batches(spark.createDataFrame(shuffled, "src string, id long, size int"), "src", "id", "size", 30, drop, ranges)
    assert got.columns == ["src", "id", "size", "batch"]
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        want |= {(*r, b) for r, b in zip(mine, pack([r[2] or 0 for r in mine], 30, drop), strict=True) if b is not None}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_packing_of_nothing_and_of_ties(spark):
    empty = spark.createDataFrame([], "src string, id long, size int")
    assert packing.pack_batches(empty, "src", "id", "size", 30).collect() == []
    twice = spark.createDataFrame([("a", 1, 1), ("a", 1, 2)], "src string, id long, size int")
    with pytest.raises(ValueError, match="same id"):
        packing.pack_batches(twice, "src", "id", "size", 30)
