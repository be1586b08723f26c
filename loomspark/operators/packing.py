"""Greedy packing of rows into batches, in order and within a budget, without a task that holds a whole key (K5).

Where a batch that begins at a row ends follows from running totals, so it is known for every row at once. A range of
rows then knows for each of its rows where a chain of batches from there leaves the range, and only these exits
are followed from range to range, in steps that double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .checkpoints import cut

#: Rows of a range, about.
RANGE_ROWS = 100_000


def running(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, n: int, ranges: int | None = None) -> DataFrame:
    """``rows`` (``n`` of them) with ``name``: the sum of ``value`` over the rows of their keys up to themselves in ``order`` (which must tell
    rows of a key apart), and ``range``, their range. Ranges are sorted and summed on their own; what goes from one to the next is one
    sum for each range and key."""
    parts = ranges or max(1, -(-n // RANGE_ROWS))
    by = [F.col(k) for k in keys]
    placed = cut(rows.withColumn(name, value).repartitionByRange(parts, *by, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = placed.groupBy(*keys, "range").agg(F.sum(name).alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    within = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # rows of one range
    return placed.withColumn(name, F.sum(name).over(within)).join(sums, [*keys, "range"]).withColumn(name, F.col(name) + F.col("before")).drop("before")


def _left(at: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For positions ``at`` (consecutive, ascending) and the positions where the next batch begins: where a chain of
    batches leaves them, and after how many batches."""
    low, n = int(at[0]), len(at)
    to, steps = then.copy(), np.ones(n, np.int64)
    while len(live := np.flatnonzero(to < low + n)):
        steps[live] += steps[to[live] - low]
        to[live] = to[to[live] - low]
    return to, steps


def _exits(table: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(table["pos"]), kind="stable")
    at, then = np.asarray(table["pos"])[order], np.asarray(table["then"])[order]
    to, steps = _left(at, then)
    return pa.table({"k": table["k"].take(pa.array(order)), "range": table["range"].take(pa.array(order)), "pos": at, "exit": to, "n": steps})


def _batches(table: pa.Table) -> pa.Table:
    """Numbers of the batches of a range's rows, from the place where the chain enters it and the batches before that."""
    order = np.argsort(np.asarray(table["pos"]), kind="stable")
    table = table.take(pa.array(order))
    at, then = np.asarray(table["pos"]), np.asarray(table["then"])
    entry, begun = table["entry"][0].as_py(), table["begun"][0].as_py()
    begins = np.zeros(len(at), np.int64)
    while entry is not None and entry <= at[-1]:
        begins[entry - at[0]] = 1
        entry = int(then[entry - at[0]])
    return pa.table({"k": table["k"], "o": table["o"], "batch": begun - 1 + np.cumsum(begins)})


def pack_batches(df: DataFrame, key: str, order: str, size: str, budget: int, drop_oversized: bool = True, ranges: int | None = None) -> DataFrame:
    """K5: ``df`` with ``batch``, filled in order within the key; a batch ends before the row that would exceed ``budget``.
    Rows over the budget are left out, or stand alone
    (behind rows of no size at most). Null keys are one key, null sizes are zero;
    ``order`` tells the rows of a key apart (else an error), a null of it comes first."""
    if clash := {"batch", "k", "o"} & set(df.columns):
        raise ValueError(f"df has columns named {sorted(clash)}")
    fits = F.coalesce(F.col(size).cast("long"), F.lit(0))
    named = df.withColumns({"k": F.to_json(F.struct(F.col(key).alias("k"))), "o": F.to_json(F.struct(F.col(order).alias("o")))})
    if drop_oversized:
        named = named.where(fits <= budget)
    rows = named.select("k", "o", F.col(order).alias("by"), fits.alias("size"))
    n = rows.count()
    if rows.groupBy("k", "o").count().where("count > 1").limit(1).count():
        raise ValueError(f"rows of one {key} have the same {order}")
    summed = running(rows, ["k"], [F.col("by")], F.lit(1).cast("long"), "pos", n, ranges).drop("range")
    summed = running(summed, ["k"], [F.col("pos")], F.col("size"), "total", n, ranges)
    # the next batch begins behind the rows whose total stays within the budget of this one, and behind its first row of any size
    begin = F.col("total") - F.col("size")
    asked = [summed.select("k", F.col("total").alias("at"), F.lit(0).alias("asks"), F.col("pos").alias("id")), summed.select("k", (begin + budget).alias("at"), F.lit(1).alias("asks"), F.col("pos").alias("id"))]
    if not drop_oversized:
        asked.append(summed.select("k", begin.alias("at"), F.lit(2).alias("asks"), F.col("pos").alias("id")))
    points = asked[0]
    for more in asked[1:]:
        points = points.unionByName(more)
    counted = running(points, ["k"], [F.col("at"), F.col("asks"), F.col("id")], (F.col("asks") == 0).cast("long"), "held", len(asked) * n, ranges)
    then = counted.where("asks > 0").groupBy("k", F.col("id").alias("pos")).agg(F.max(F.col("held") + F.col("asks")).alias("then"))
    whole = cut(summed.join(then, ["k", "pos"]).select("k", "o", "range", "pos", "then"))
    exits = cut(whole.select("k", "range", "pos", "then").groupBy("k", "range").applyInArrow(_exits, "k string, range int, pos long, exit long, n long"))
    first = exits.select("k", F.lit(1).cast("long").alias("pos")).distinct()
    doors = first.unionByName(exits.select("k", F.col("exit").alias("pos")).distinct()).distinct()
    jump = cut(exits.join(doors, ["k", "pos"]).select("k", "pos", "exit", "n"))
    reached = cut(first.withColumn("begun", F.lit(0).cast("long")))
    while not jump.isEmpty():  # a step is twice as long as the last one
        more = reached.join(jump, ["k", "pos"]).select("k", F.col("exit").alias("pos"), (F.col("begun") + F.col("n")).alias("begun"))
        reached = cut(reached.unionByName(more))
        on = jump.select("k", F.col("pos").alias("exit"), F.col("exit").alias("far"), F.col("n").alias("m"))
        jump = cut(jump.join(on, ["k", "exit"]).select("k", "pos", F.col("far").alias("exit"), (F.col("n") + F.col("m")).alias("n")))
    entered = exits.join(reached, ["k", "pos"]).select("k", "range", F.col("pos").alias("entry"), "begun", (F.col("begun") + F.col("n")).alias("after"))
    earlier = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    every = exits.select("k", "range").distinct().join(entered, ["k", "range"], "left").withColumn("begun", F.coalesce("begun", F.max("after").over(earlier))).select("k", "range", "entry", "begun")
    numbered = whole.join(every, ["k", "range"]).groupBy("k", "range").applyInArrow(_batches, "k string, o string, batch long")
    return named.join(numbered, ["k", "o"]).select(*df.columns, "batch")
