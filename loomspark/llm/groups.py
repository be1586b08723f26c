"""Exact linking inside candidate groups of any size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components, keep

GROUP_BYTES = 48 << 20
#: Classes that go past all chunks of their group at a time.
TILE = 256
#: Rows of a batch of links.
ROWS = 10_000
PAIRS = "a binary, b binary"
PACKED = "cls binary, grp binary, part int, items binary"

#: Gets the packed items of classes, returns a number for each that is equal where they are linked.
Link = Callable[[list[bytes]], list[int]]


def _linked(link: Link):
    """Over rows in the order of (grp, part): one group at a time is held."""

    def pairs(rows: dict[bytes, bytes]) -> tuple[list[bytes], list[bytes]]:
        names = sorted(rows, key=lambda c: (len(rows[c]), c))
        roots = link([rows[c] for c in names])
        least: dict[int, bytes] = {}
        for name, root in zip(names, roots, strict=True):
            least[root] = min(least.get(root, name), name)
        return names, [least[r] for r in roots]

    def run(batches):
        at, rows = None, {}  # a class may come more than once
        a: list[bytes] = []
        b: list[bytes] = []
        for batch in batches:
            for cls, *key, items in zip(*(batch.column(c).to_pylist() for c in ("cls", "grp", "part", "items")), strict=True):
                if key != at:
                    for out, new in zip((a, b), pairs(rows), strict=True):
                        out += new
                    at, rows = key, {}
                    if len(a) > ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                        a, b = [], []
                rows[cls] = items
        for out, new in zip((a, b), pairs(rows), strict=True):
            out += new
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _within_groups(packed: DataFrame, link: Link) -> DataFrame:
    """(a, b): each class and the smallest one it is linked to among those of its chunk. A task walks through its groups
    in their order, so many small ones cost little. As many tasks as are set: few bytes may be much work."""
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(tasks, "grp", "part").sortWithinPartitions("grp", "part").mapInArrow(_linked(link), PAIRS)


def dealt(groups: DataFrame, cut: Scratch) -> tuple[DataFrame, DataFrame]:
    """``groups`` (with grp, cls and bytes) with the chunk (part) of each class, and (grp, parts) of the groups of more than one chunk."""
    parts = groups.groupBy("grp").agg(F.ceil(F.sum("bytes") / GROUP_BYTES).cast("int").alias("parts"))
    oversized = cut(parts.where("parts > 1"))  # at most total bytes / GROUP_BYTES rows
    if oversized.isEmpty():
        return groups.withColumn("part", F.lit(0)), oversized
    chunk = F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))).cast("int")
    return groups.join(oversized, "grp", "left").withColumn("part", chunk).drop("parts"), oversized


def link_groups(packed: DataFrame, oversized: DataFrame, link: Link, cut: Scratch) -> DataFrame:
    """(node, root) of classes, from PACKED rows. A group of one chunk is linked in one task.
    Of a larger one the chunks are linked first; then every class outside the group's
    largest component goes past all chunks, TILE at a time, until nothing can be missing."""
    many = not oversized.isEmpty()
    packed = cut(packed) if many else packed  # read once for each tile
    links = cut(_within_groups(packed, link))
    if not many:
        return keep(links.select(F.col("a").alias("node"), F.col("b").alias("root")))
    large = packed.join(oversized, "grp")
    done = None
    while True:
        roots = components(links.where("a <> b"))
        now = cut(large.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "grp", F.coalesce("root", "cls").alias("root"), F.octet_length("items").alias("size")))
        most = now.groupBy("grp", "root").agg(F.sum("size").alias("size")).groupBy("grp").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
        rest = now.join(most, "grp").where("root <> largest").select("grp", "cls").distinct()
        rest = rest if done is None else rest.join(done, ["grp", "cls"], "left_anti")
        tile = cut(rest.orderBy("grp", "cls").limit(TILE))
        cut.drop(now)
        if tile.isEmpty():
            return roots
        out = large.join(F.broadcast(tile), ["grp", "cls"]).select("cls", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "items")
        past = large.select("cls", "grp", "part", "items").join(F.broadcast(tile.select("grp").distinct()), "grp")
        last, links = links, cut(links.unionByName(_within_groups(past.unionByName(out), link)).distinct())
        cut.drop(last)
        done = tile if done is None else cut(done.unionByName(tile))
