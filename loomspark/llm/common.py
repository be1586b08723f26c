"""Shared building blocks of the training-data operators: Arrow buffers, word and window
hashes, tables of intermediate results and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Separators of words: blank and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in
    ``spark.checkpoint.dir``. Only a single machine (tests) may leave that unset; it gets
    a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: what an operator returns. Spark removes it
    with its last reference (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more; else they
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of an operator in the shared folder, deleted as soon as the block ends:
    ``with Scratch(spark) as cut: df = cut(df)``. What outlives the block goes through :func:`keep`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: its lineage ends there."""
        self.tables += 1
        df.write.parquet(f"{self.folder}/{self.tables}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.tables}")
        out.scratch_table = self.tables
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete the table of a frame that is no longer needed."""
        if df is not None:
            self._delete(f"{self.folder}/{df.scratch_table}")

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)
        release(self.spark)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes of windows are polynomials modulo this prime, with bases drawn at random.
PRIME = np.uint64(2**61 - 1)
_LOW32, _LOW29 = np.uint64(2**32 - 1), np.uint64(2**29 - 1)
_SLICE = 1 << 14
_U = {n: np.uint64(n) for n in (3, 29, 32, 61)}


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, for any 64-bit ``x``."""
    x = (x & PRIME) + (x >> _U[61])
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, from halves of 32 and 29 bits (2**61 is 1, 2**64 is 8)."""
    if len(a) > _SLICE:  # a slice at a time stays in the processor's cache
        return np.concatenate([times(a[i : i + _SLICE], b[i : i + _SLICE] if b.ndim else b) for i in range(0, len(a), _SLICE)])
    a1, a0, b1, b0 = a >> _U[32], a & _LOW32, b >> _U[32], b & _LOW32
    middle = a1 * b0 + a0 * b1
    low = a0 * b0
    return _reduced((a1 * b1 << _U[3]) + (middle >> _U[29]) + ((middle & _LOW29) << _U[32]) + (low & PRIME) + (low >> _U[61]))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse for i < n, modulo PRIME."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        both = []
        for b in (base, pow(base, -1, int(PRIME))):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, 1024):
                out = np.concatenate([out, times(out, np.uint64(pow(b, len(out), int(PRIME))))])
            both.append(out)
        have = _POWERS[base] = tuple(both)
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**61 - 1 of each slice ``values[start:end]``; the base follows from ``seed``.

    Two different slices of n values get one hash for at most n of the 2**61 bases, whatever
    their content (modulo 2**64 there is content that collides for every base). ``values`` are
    hashes themselves; the result is mixed to 64 bits with the length."""
    base = int(np.random.default_rng(seed).integers(2**40, 2**61 - 2))
    up, down = powers(base, len(values) + 1)
    terms = times(values >> _U[3], up[:-1])
    total = np.zeros(len(values) + 1, np.uint64)
    high = np.cumsum(terms >> _U[32])  # in halves: sums of terms don't fit 64 bits
    total[1:] = _reduced((high >> _U[29]) + ((high & _LOW29) << _U[32]) + _reduced(np.cumsum(terms & _LOW32)))
    return mix(times(_reduced(total[ends] + PRIME - total[starts]), down[starts]) + ((ends - starts).astype(np.uint64) << np.uint64(40)))


#: Of the eight bytes from a place on, those that belong to a word of so many more.
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """Words of a column of texts: ``doc`` (row of each word), ``start`` and
    ``end`` (bytes in ``data``), ``first`` (index of each row's first word; one
    more entry than rows). Null texts have no words."""

    def __init__(self, texts: pa.Array, lower: bool = False, table: np.ndarray | None = None):
        self.data, offsets = buffers(texts)
        if lower or table is not None:
            self.data = (_LOWER if table is None else table)[self.data]
        inside = np.zeros(len(self.data) + 2, bool)
        np.logical_not(SPACE[self.data], out=inside[1:-1])
        begins = inside[1:] & ~inside[:-1]
        ends = ~inside[1:] & inside[:-1]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(self.data))]
        joined = cuts[inside[cuts] & inside[cuts + 1]]  # a word runs over the end of a text
        begins[joined] = ends[joined] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits of each word: its bytes go in by eight, each time through :func:`mix`. (A chain
        of bijections of the eight bytes, not a polynomial: no structure of a word cancels out.)"""
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray(len(self.data) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
        left = self.end - self.start
        h = mix(left.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        at, live = self.start, None
        while len(left):
            block = eight[at] & _TAILS[np.minimum(left, 8)]
            if live is None:
                h = mix(h ^ block * np.uint64(0xD6E8FEB86659FD93))
            else:
                h[live] = mix(h[live] ^ block * np.uint64(0xD6E8FEB86659FD93))
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
        return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each row begins (and the last ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chained(h: np.ndarray, begin: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each run of ``count`` (few) words from ``begin`` on, given the words' hashes."""
    out = mix(count.astype(np.uint64) + np.uint64(seed))
    for j in range(int(count.max()) if len(count) else 0):
        live = np.flatnonzero(count > j)
        out[live] = mix(out[live] * np.uint64(0xD6E8FEB86659FD93) ^ h[begin[live] + j])
    return out


def sequence_names(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits of each run of words: two sums of hashes of (word, place in the run)."""
    size = last - first
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words = h[place + np.repeat(first, size)]
    edges = np.r_[0, np.cumsum(size)]
    out = np.empty((len(first), 2), np.uint64)
    for k, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ mix(place.astype(np.uint64) + np.uint64(salt))), out=total[1:])
        out[:, k] = mix(total[edges[1:]] - total[edges[:-1]] + size.astype(np.uint64))
    return out


def packed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` as Zstandard frames: a shuffle of them moves about half as much."""

    def run(batches):
        codec = pa.Codec("zstd")
        for table in chunks(batches, 2 << 20):
            raw = [None if t is None else t.encode() for t in table["text"].to_pylist()]
            frames = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw]
            yield from table.set_column(table.schema.get_field_index("text"), "text", pa.array(frames, pa.binary())).combine_chunks().to_batches()

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in rows.schema])
    return rows.mapInArrow(run, schema)


def unpacked(frames: list[bytes | None]) -> list[str | None]:
    codec = pa.Codec("zstd")
    return [None if f is None else codec.decompress(f[8:], int.from_bytes(f[:8], "little"), asbytes=True).decode() for f in frames]


def window_hashes(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (index of its first word) of each window of ``size`` words within one row, and two hashes of it from independent bases."""
    at = np.arange(max(0, len(words.start) - size + 1))
    at = at[words.doc[at] == words.doc[at + size - 1]] if len(at) else at
    h = words.hashes(seed)
    return at, rolling(h, at, at + size, seed + 1), rolling(h, at, at + size, seed + 2)


def give_back() -> None:
    """Return a finished task's memory: workers live on and run tasks of other operators."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches, max_bytes: int, column: str = "text"):
    """Regroup Arrow batches into tables of about ``max_bytes`` of text, whatever
    the size of the batches that come in; a longer single row stands alone."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        begin = 0
        while begin < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[begin:]), max_bytes - size, "right")
            end = min(len(sizes), begin + max(int(room), 1 if not held else 0))
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += int(sizes[begin:end].sum())
                begin = end
            if begin < len(sizes):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    del held
    give_back()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest nodes, at most one edge for each node."""
    for table in gathered(batches, 1 << 20):
        both = pa.concat_arrays([table[c].combine_chunks() for c in ("u", "v")]).dictionary_encode()
        ascending = pc.sort_indices(both.dictionary)
        nodes, rank = both.dictionary.take(ascending), np.argsort(np.asarray(ascending))
        ends = rank[np.asarray(both.indices)].reshape(2, -1)
        root = roots_of(ends[0], ends[1], len(nodes))
        tied = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(tied)), nodes.take(pa.array(root[tied]))], ["u", "v"])


def gathered(batches, rows: int):
    """Arrow batches as tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def roots_of(a: np.ndarray, b: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to n - 1 and edges a - b."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        live = x != y
        if not live.any():
            return root
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: (node, root), root being the smallest node.

    Each task shrinks its edges to stars; then large-star and small-star steps alternate with that:
    each is one grouped minimum and one join over the edges alone, nothing is gathered per node.
    The minima are written before the join, so that both its sides are plain exchanges and
    adaptive execution splits a node of very many edges. Ends when every node has one edge, to a
    smaller node that has none to a smaller one (an error if that takes over ``rounds``); loops and
    nulls are ignored. Nodes without edges don't occur.
    """
    spark = edges.sparkSession
    with Scratch(spark) as cut:
        oriented = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        shrunk = lambda df: oriented(df.mapInArrow(_contracted, df.schema))
        now = cut(shrunk(shrunk(oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))).distinct()))
        for _ in range(rounds):
            ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up")))
            if ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or up = 1 and low = 0").isEmpty():
                break
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            down = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            last, now = now, cut(shrunk(shrunk(oriented(small)).distinct()))
            cut.drop(low)
            cut.drop(last)
            del both, low, down, least, small, last, ends
            release(spark)
        else:
            raise RuntimeError(f"components have not converged after {rounds} rounds")
        roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return keep(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
