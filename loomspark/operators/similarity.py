"""Upkeep of a similarity join: only what changed is compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .checkpoints import cut
from .retrieval import near_rows, of_lists, unit_rows


def pairs_with(asked: DataFrame, vectors: DataFrame, least: float, vec: str = "vec_id", block_rows: int = 16_384, per_row: int | None = None) -> DataFrame:
    """(a < b, score): pairs of a row of ``asked`` and one of ``vectors`` with cosine >= ``least``, each once. With ``per_row`` only those
    that are among the best of either end within their blocks, so none that a list of so many holds is missing.

    Both sides are dealt to blocks; a task multiplies one block of each, so the work is the product of the two
    sides' sizes. Rows of unlike lengths, and null, empty and zero vectors, have no pairs."""
    rows = lambda df: df.where(F.size("embedding") > 0).select(F.col(vec).cast("long").alias("vec"), F.col("embedding").alias("x"), F.size("embedding").alias("dim"))
    few, many = max(1, -(-asked.count() // block_rows)), max(1, -(-vectors.count() // block_rows))
    block = lambda n: F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows(asked).withColumn("i", block(few)).withColumn("j", every(many))
    right = rows(vectors).withColumn("j", block(many)).withColumn("i", every(few))

    def product(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = near_rows(unit_rows(x), unit_rows(y), least, per_row, False)
        a, b = np.asarray(found["a"]), np.asarray(found["b"])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": found["score"]})

    cells = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j"))
    return cells.applyInArrow(product, "a long, b long, score double").dropDuplicates(["a", "b"])


def nearest_lists(pairs: DataFrame, per_row: int) -> DataFrame:
    """Pairs of which either end is among the other's ``per_row`` best (ties to smaller ids)."""
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return of_lists(both, per_row)


def updated_pairs(pairs: DataFrame, vectors: DataFrame, changed: DataFrame, least: float, per_row: int, vec: str = "vec_id", block_rows: int = 16_384) -> DataFrame:
    """(a < b, score) of a full run over ``vectors``, the rows as they are now, from the stored ``pairs`` of one before and the ids
    ``changed`` since then: rows that came, got another vector or went.

    Changed rows are compared with all; so are rows that have lost a pair, as what stood next in
    their list was never stored. All other rows' lists can only gain changed rows."""
    ids = cut(changed.select(F.col(vec).cast("long").alias("id")).distinct())
    end = lambda c: ids.withColumnRenamed("id", c)
    lost = pairs.join(end("a"), "a", "left_semi").select(F.col("b").alias("id")).unionByName(pairs.join(end("b"), "b", "left_semi").select(F.col("a").alias("id")))
    again = cut(lost.unionByName(ids).distinct())
    kept = pairs.join(end("a"), "a", "left_anti").join(end("b"), "b", "left_anti").select("a", "b", "score")
    asked = cut(vectors.join(again.withColumnRenamed("id", vec), vec, "left_semi"))
    fresh = pairs_with(asked, vectors, least, vec, block_rows, per_row)
    return nearest_lists(kept.unionByName(fresh).dropDuplicates(["a", "b"]), per_row)
