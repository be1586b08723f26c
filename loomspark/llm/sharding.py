"""Sharding by extendible hashing (operator 3), in DataFrame functions only.

A row hashes to 60 bits: 28 of its keys, then 32 of its id and size, so that rows of
one key stay together until their bucket must split, and a key that holds a third of
all rows still splits. A directory indexed by hash-prefix bits maps to buckets of
their own local depth; only a bucket over the byte limit splits, on one more bit,
until every shard fits. The directory is made from a byte histogram of prefixes,
pre-aggregated in each task, so neither texts nor rows of a bucket meet anywhere.

Rows alike in keys, id and size differ in no bit. Where these alone exceed the limit
they are counted, and the count is dealt out over numbered overflow pages.

Defined results: a null key is a key of its own; null and empty texts have 0 bytes; a
row that alone exceeds the limit stands alone in its page (nothing can split it); an
empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import keep

KEY_BITS, ROW_BITS = 28, 32
BITS = KEY_BITS + ROW_BITS


def _bits(n: int, *columns: Column) -> Column:
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n // 4), 16, 10).cast("long")


def _prefix(h: Column, bits: int | Column, of: int | Column = BITS) -> Column:
    """The first ``bits`` of the ``of`` bits of a hash."""
    rest = (of if isinstance(of, Column) else F.lit(of)) - (bits if isinstance(bits, Column) else F.lit(bits))
    return F.call_function("shiftright", h, rest)


def _leaves(histogram: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(idx, depth): for each prefix of ``high`` bits the least local depth from ``low`` on whose bucket fits; null where none does."""
    levels = histogram.select("idx", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("p", _prefix(F.col("idx"), F.col("depth"), high))
    fits = levels.groupBy("depth", "p").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit).select("depth", "p")
    best = levels.join(fits, ["depth", "p"]).groupBy("idx").agg(F.min("depth").alias("depth"))
    return histogram.select("idx").join(best, "idx", "left")


def _named(rows: DataFrame, page: Column | None = None) -> DataFrame:
    bits = F.call_function("left", F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0"), F.col("depth"))
    return rows.select("doc_id", "n_bytes", (bits if page is None else F.concat_ws(".", bits, page.cast("string"))).alias("shard"), F.col("depth").cast("long").alias("depth"))


def shard_ids(docs: DataFrame, limit: int = 64 << 20, keys: tuple[str, ...] = ("doc_id",), slack: int = 6) -> DataFrame:
    """(doc_id, n_bytes, shard, depth): ``shard`` is the bucket's prefix as a string of bits
    (with ``.page`` past the last bit), ``depth`` the number of bits.

    ``limit``: bytes of text a shard may hold. Depths up to the even one plus
    ``slack`` come from one histogram; only buckets still too large get a deeper one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    h = _bits(KEY_BITS, *map(F.col, keys)) * (1 << ROW_BITS) + _bits(ROW_BITS, F.col("doc_id"), size)
    rows = docs.select("doc_id", size.alias("n_bytes"), h.alias("h"))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + slack)
    out = None
    while True:
        histogram = rows.groupBy(_prefix(F.col("h"), high).alias("idx")).agg(F.sum("n_bytes").alias("bytes"))
        leaves = _leaves(histogram, low, high, limit)
        placed = rows.withColumn("idx", _prefix(F.col("h"), high)).join(leaves, "idx")
        done = _named(placed.where("depth is not null"))
        out = done if out is None else out.unionByName(done)
        oversized = leaves.where("depth is null").select("idx")
        if oversized.isEmpty():
            return out
        rows = keep(rows.withColumn("idx", _prefix(F.col("h"), high)).join(oversized, "idx", "left_semi").drop("idx"))
        if high == BITS:
            return out.unionByName(_pages(rows, limit))
        low, high = high + 1, min(BITS, high + 3 * slack)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    alike = rows.groupBy("h", "doc_id", "n_bytes").agg(F.count("*").alias("n"))
    each = alike.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("depth", F.lit(BITS))
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1).cast("long"))))
    return _named(each, F.floor(F.col("i") / per))


def oracle(limit: int) -> str:
    """DuckDB SQL of :func:`shard_ids` with the key doc_id, overflow pages included."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents),
h AS (SELECT doc_id, n_bytes, row_number() OVER (PARTITION BY doc_id, n_bytes) - 1 AS i, CAST('0x' || substr(md5('v' || doc_id), 1, {KEY_BITS // 4}) AS BIGINT) * {1 << ROW_BITS}
             + CAST('0x' || substr(md5('v' || doc_id || '|v' || n_bytes), 1, {ROW_BITS // 4}) AS BIGINT) AS h FROM r),
l AS (SELECT doc_id, n_bytes, i, h, d, h >> ({BITS} - d) AS p FROM h, (SELECT unnest(range(0, {BITS + 1})) AS d)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY d, p) AS held FROM l),
f AS (SELECT doc_id, n_bytes, i, h, min(d) FILTER (held <= {limit}) AS fits FROM s GROUP BY doc_id, n_bytes, i, h)
SELECT doc_id, n_bytes, CAST(coalesce(fits, {BITS}) AS BIGINT) AS depth,
       substr(lpad(bin(h), {BITS}, '0'), 1, CAST(coalesce(fits, {BITS}) AS INTEGER))
       || CASE WHEN fits IS NULL THEN '.' || CAST(i // greatest(1, {limit} // greatest(n_bytes, 1)) AS BIGINT) ELSE '' END AS shard FROM f
"""
