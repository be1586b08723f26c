"""A stored inverted index: postings written once, searched many times, kept up to date by segments.

An index is a folder of Parquet tables that all executors share. Each commit adds a segment:

* ``docs`` (doc, shard, length, tokens, tfs): the forward side, from which blocks, deletions and merges are computed. A shard is a run of
  the rows that a task writes, so that no row moves;
* ``blocks`` (token, shard, docs, tfs, lengths, most_tf, least_length): the postings of a token in a shard of documents (in several rows, if
  the shard was read in several pieces), sorted by token within the shard, made where the shard is read; the last two columns bound what any document of the block can score;
* ``dead`` (seg, shard, doc): documents of older segments that this commit replaces or deletes;
* ``terms`` (token, df): changes of document frequencies, so that statistics are exact after every commit.

A commit counts once its row is in ``log``; what a failed one has left is never read. ``merge`` writes
all live documents into one segment. One writer at a time is assumed.

A search sends its tokens to the blocks, so only postings of wanted tokens move, as arrays; each
(segment, shard, block of queries) is scored in one task, and returns its own best. With many shards
two rounds are made: each query's most promising shard gives a score that its ``k`` best can't fall
below, and then only shards whose bound reaches that are scored. Results equal those of a full scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .checkpoints import cut, shared_folder
from .retrieval import checked_broadcast, tiered, top_k

#: Most postings and documents of a shard (of postings one document more), queries that are scored together, and tokens that are looked up by name.
SHARD_POSTINGS, SHARD_DOCS, TOGETHER, FEW_TOKENS = 1_000_000, 16_384, 256, 200
#: Bytes of a row group of blocks (a few shards: their ids stay in Parquet's dictionaries), rows of a batch of blocks, and most keys of dead documents that go to every task.
ROW_GROUP, BATCH_ROWS, DEAD_ROWS = 16 << 20, 4096, 1_000_000
K1, B = 1.2, 0.75

BLOCKS = "token string, shard long, docs array<long>, tfs array<int>, lengths array<int>, most_tf int, least_length int"
DOCS = "doc long, shard long, length int, tokens array<string>, tfs array<int>"
LOG = "seg int, base boolean, shards int, n_docs long, total_length long"
DEAD = "seg int, shard long, doc long"
HIT = "query long, doc long, score double, n_tokens int"


def part_score(tf, length, mean: float):
    """What a token of weight 1 adds to a document's score."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _bags(batches):
    """Distinct tokens of each row that has any, with their counts, in order of their first occurrence in the batch, and its shard: a run of this task's rows."""
    base, n_docs, n_postings = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0), 0))
        tokens = batch.column("tokens")
        length = np.asarray(pc.list_value_length(tokens)).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(len(length)), length) * size + np.asarray(coded.indices).astype(np.int64), return_counts=True)
        first = np.searchsorted(pairs // size, np.arange(len(length) + 1))
        shard = base + (n_docs + np.arange(len(length))) // SHARD_DOCS + (n_postings + first[:-1]) // SHARD_POSTINGS
        n_docs, n_postings = n_docs + len(length), n_postings + len(pairs)
        ends = pa.array(first.astype(np.int32))
        words = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % size)))
        columns = [batch.column("doc"), pa.array(shard), pa.array(length.astype(np.int32)), words, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "shard", "length", "tokens", "tfs"])


def _repeated() -> Column:
    """Tokens of a bag as often as they occur."""
    return F.flatten(F.transform(F.arrays_zip("tokens", "tfs"), lambda x: F.array_repeat(x["tokens"], x["tfs"])))


def _inverted(table: pa.Table) -> pa.Table:
    """Blocks of one shard from its documents, tokens in order."""
    docs, length = np.asarray(table["doc"]), np.asarray(table["length"])
    words = table["tokens"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    own = np.repeat(np.arange(len(docs)), np.asarray(pc.list_value_length(words)))
    tfs = np.asarray(table["tfs"].combine_chunks().flatten())
    rank = np.empty(len(coded.dictionary), np.int64)
    ascending = np.asarray(pc.sort_indices(coded.dictionary))
    rank[ascending] = np.arange(len(rank))
    key = rank[np.asarray(coded.indices)]
    order = np.lexsort((docs[own], key))
    first = np.searchsorted(key[order], np.arange(len(rank) + 1))
    at, tfs = own[order], tfs[order]
    ends = pa.array(first.astype(np.int32))
    column = lambda values, t: pa.ListArray.from_arrays(ends, pa.array(values, t))
    shard = pa.array(np.full(len(rank), table["shard"][0].as_py()), pa.int64())
    most, least = (f.reduceat(x, first[:-1]) if len(rank) else x for f, x in ((np.maximum, tfs), (np.minimum, length[at])))
    columns = [coded.dictionary.take(pa.array(ascending)), shard, column(docs[at], pa.int64()), column(tfs, pa.int32()), column(length[at], pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32())]
    return pa.table(columns, names=["token", "shard", "docs", "tfs", "lengths", "most_tf", "least_length"])


def _blocks_of(batches):
    """Blocks of each run of rows of one shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = np.asarray(batch.column("shard"))
        edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
            if held and hi > lo and held[-1].column("shard")[0] != batch.column("shard")[lo]:
                yield from _inverted(pa.Table.from_batches(held)).to_batches(BATCH_ROWS)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from _inverted(pa.Table.from_batches(held)).to_batches(BATCH_ROWS)


class TextIndex:
    """The index in ``folder``; :meth:`build` makes one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # ---------------------------------------------------------------- commits

    @classmethod
    def build(cls, docs: DataFrame, doc: str, tokens: Column, folder: str | None = None, shards: int | None = None) -> TextIndex:
        """An index of ``docs``; ``tokens`` is the column of their tokens. Rows without id take no part; of one id all tokens count."""
        index = cls(docs.sparkSession, folder or f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}")
        index._commit(docs.select(F.col(doc).cast("long").alias("doc"), tokens.alias("tokens")), None, shards)
        return index

    def upsert(self, docs: DataFrame, doc: str, tokens: Column, shards: int | None = None) -> None:
        """Add documents; those that the index has already are replaced."""
        new = docs.select(F.col(doc).cast("long").alias("doc"), tokens.alias("tokens"))
        self._commit(new, new.select("doc").distinct(), shards)

    def delete(self, ids: DataFrame, doc: str) -> None:
        gone = ids.select(F.col(doc).cast("long").alias("doc")).distinct()
        self._commit(None, gone, None)

    def merge(self, shards: int | None = None) -> None:
        """All live documents as one segment; older ones are no longer read."""
        self._commit(self._live().select("doc", _repeated().alias("tokens")), None, shards)

    def _commit(self, new: DataFrame | None, gone: DataFrame | None, shards: int | None) -> None:
        """``gone`` (doc): what stood in the index until now; None: a base, which stands for all before it. ``shards``: at least so many tasks."""
        seg = int(self.spark.read.schema(LOG).parquet(f"{self.folder}/log").agg(F.max("seg")).first()[0]) + 1 if self._exists("log") else 0
        at, base = f"{self.folder}/seg={seg}", gone is None
        n, total, n_shards, terms = 0, 0, 0, []
        if gone is not None:
            log = self.log()
            keys = checked_broadcast(cut(self._live("seg", "shard", "doc").join(gone, "doc", "left_semi").select("seg", "shard", "doc")), DEAD_ROWS)  # tokens needn't move to be found
            dead = self._tables("docs", DOCS, log).join(keys, ["seg", "shard", "doc"], "left_semi")
            dead.select("seg", "shard", "doc", "length", "tokens").write.mode("overwrite").parquet(f"{at}/dead")
            dead = self.spark.read.schema(f"{DEAD}, length int, tokens array<string>").parquet(f"{at}/dead")
            less = dead.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            n, total = -less[0], -less[1]
            terms.append(dead.select(F.explode("tokens").alias("token")).groupBy("token").agg((-F.count("*")).alias("df")))
        if new is not None:
            new = new.where("doc is not null")
            if shards:
                new = new.repartition(shards, "doc")
            rows, ids = new.agg(F.count("*"), F.count_distinct("doc")).first()
            if ids < rows:  # an id stands in several rows: all their tokens count
                new = new.groupBy("doc").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
            new.mapInArrow(_bags, DOCS).write.mode("overwrite").parquet(f"{at}/docs")  # rows without tokens go there: a filter would tokenise twice
            kept = self.spark.read.schema(DOCS).parquet(f"{at}/docs")
            more = kept.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("shard")).first()
            n, total, n_shards = n + more[0], total + more[1], more[2]
            kept.mapInArrow(_blocks_of, BLOCKS).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{at}/blocks")
            terms.append(self.spark.read.schema(BLOCKS).parquet(f"{at}/blocks").groupBy("token").agg(F.sum(F.size("docs")).alias("df")))
        changed = terms[0] if len(terms) == 1 else terms[0].unionByName(terms[1]).groupBy("token").agg(F.sum("df").alias("df"))
        changed.where("df <> 0").write.mode("overwrite").parquet(f"{at}/terms")
        self.spark.createDataFrame([(seg, base, n_shards, n, total)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    # ---------------------------------------------------------------- reading

    def _at(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, name: str) -> bool:
        files, path = self._at(f"{self.folder}/{name}")
        return files.exists(path)

    def log(self) -> list:
        """Rows of the commits that are read: from the last base on (one row a commit)."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.folder}/log").orderBy("seg").collect()
        last = max(i for i, r in enumerate(rows) if r["base"])
        return rows[last:]

    def _tables(self, name: str, schema: str, log: list) -> DataFrame:
        """The table ``name`` of all segments that have one, with ``seg``."""
        found = [self.spark.read.schema(schema).parquet(f"{self.folder}/seg={r['seg']}/{name}").withColumn("seg", F.lit(r["seg"])) for r in log if self._exists(f"seg={r['seg']}/{name}")]
        out = found[0] if found else self.spark.createDataFrame([], f"{schema}, seg int")
        for df in found[1:]:
            out = out.unionByName(df)
        return out

    def _dead(self, log: list) -> DataFrame:
        found = [f"{self.folder}/seg={r['seg']}/dead" for r in log if not r["base"]]
        return self.spark.read.schema(DEAD).parquet(*found) if found else self.spark.createDataFrame([], DEAD)

    def _live(self, *columns: str) -> DataFrame:
        """Rows (or some columns) of live documents."""
        log = self.log()
        rows = self._tables("docs", DOCS, log).select(*(columns or "*"))
        return rows if len(log) == 1 else rows.join(checked_broadcast(self._dead(log), DEAD_ROWS), ["seg", "shard", "doc"], "left_anti")

    def documents(self) -> DataFrame:
        """(doc, length) of live documents."""
        return self._live().select("doc", "length")

    def stats(self) -> tuple[int, float]:
        """Number and mean length of live documents."""
        return self._stats(self.log())

    def _stats(self, log: list) -> tuple[int, float]:
        n, total = sum(r["n_docs"] for r in log), sum(r["total_length"] for r in log)
        return n, total / n if n else 1.0

    def terms(self) -> DataFrame:
        """(token, df) of live documents."""
        log = self.log()
        folders = [f"{self.folder}/seg={r['seg']}/terms" for r in log]
        changes = self.spark.read.schema("token string, df long").parquet(*folders)
        return changes if len(log) == 1 else changes.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def _blocks(self, log: list, tokens: list[str] | None) -> DataFrame:
        """Blocks of all segments; of a few known tokens, only the pages that may hold them."""
        out = None
        for r in (r for r in log if self._exists(f"seg={r['seg']}/blocks")):
            df = self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/seg={r['seg']}/blocks").withColumn("seg", F.lit(r["seg"]))
            if tokens is not None:
                df = df.where(F.col("token").isin(tokens))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], f"{BLOCKS}, seg int")

    # ---------------------------------------------------------------- search

    def search(self, queries: DataFrame, k: int, query: str = "query_id", by: Sequence[str] = ("score",), every_token: bool = False, scope: DataFrame | None = None, prune_from: int = 32, digits: int = 6) -> DataFrame:
        """(query, doc, score, n_tokens) of live documents with any (or every) token of a query, from (query, token).

        A shard returns what is among the ``k`` best by any of ``by`` ("score", rounded to ``digits``, or "n_tokens"; ties to smaller
        ids); rank them with ``top_k``. With ``every_token`` all matching documents are returned. ``scope``
        (doc) bounds what is returned, not the statistics. Two rounds are made from ``prune_from`` shards on.
        Queries without a known token have no rows."""
        log = self.log()
        n, mean = self._stats(log)
        wanted = queries.select(F.col(query).cast("long").alias("query"), "token").distinct()
        wanted = cut(wanted.withColumn("n_wanted", F.count("*").over(Window.partitionBy("query")).cast("int")))
        blocks = max(1, -(-wanted.agg(F.count_distinct("query")).first()[0] // TOGETHER))
        few = [r["token"] for r in wanted.select("token").distinct().limit(FEW_TOKENS + 1).collect()]
        postings = self._blocks(log, few if len(few) <= FEW_TOKENS else None)
        if len(few) > FEW_TOKENS:
            postings = postings.join(checked_broadcast(wanted.select("token").distinct()), "token", "left_semi")
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        block = F.pmod(F.xxhash64("query"), F.lit(blocks))
        terms = self.terms().join(checked_broadcast(wanted.select("token").distinct()), "token", "left_semi")
        weighted = cut(wanted.join(terms, "token").select("query", "token", "n_wanted", idf.alias("idf"), block.cast("int").alias("block")))
        hidden = self._hidden(log, scope)
        settings = {"k": k, "by": tuple(by), "every_token": every_token, "mean": mean, "digits": digits}
        if every_token or sum(r["shards"] for r in log) < prune_from:
            return self._scored(postings, weighted, [], hidden, blocks, settings).withColumnRenamed("query", query)

        heads = postings.select("token", "seg", "shard", "most_tf", "least_length")
        adds = F.col("idf") * part_score(F.col("most_tf"), F.col("least_length"), mean)
        bound = cut(heads.join(checked_broadcast(weighted), "token").groupBy("query", "seg", "shard").agg(F.sum(adds).alias("most"), F.count("*").alias("most_tokens")))
        home = cut(top_k(bound, "query", [F.desc("most"), F.col("seg"), F.col("shard")], 1).select("query", "seg", "shard"))
        first = cut(self._scored(postings, weighted.join(home, "query"), ["seg", "shard"], hidden, blocks, settings))
        reached = F.lit(False)
        low = wanted.select("query").distinct()
        for c, most in (("score", F.col("most") * (1 + 1e-9) + 10.0**-digits), ("n_tokens", F.col("most_tokens"))):
            if c in by:  # the k-th best of the first round: what scores less can't be among the k best
                kth = top_k(first, "query", [F.desc(c), F.col("doc")], k).where(F.col("rank") == k).select("query", F.col(c).alias(f"low_{c}"))
                low = low.join(kth, "query", "left")
                reached = reached | F.col(f"low_{c}").isNull() | (most >= F.col(f"low_{c}"))
        further = bound.join(low, "query").where(reached).join(home, ["query", "seg", "shard"], "left_anti").select("query", "seg", "shard")
        return first.unionByName(self._scored(postings, weighted.join(further, "query"), ["seg", "shard"], hidden, blocks, settings)).withColumnRenamed("query", query)

    def _hidden(self, log: list, scope: DataFrame | None) -> DataFrame | None:
        """(seg, shard, doc) that a search must not return: dead documents, and those outside ``scope``."""
        dead = self._dead(log) if len(log) > 1 else None
        if scope is None:
            return dead
        outside = self._tables("docs", DOCS, log).select("seg", "shard", "doc").join(scope.select(F.col(scope.columns[0]).cast("long").alias("doc")), "doc", "left_anti").select("seg", "shard", "doc")
        return outside.unionByName(dead).distinct() if dead is not None else outside

    def _scored(self, postings: DataFrame, weighted: DataFrame, where: list[str], hidden: DataFrame | None, blocks: int, settings: dict) -> DataFrame:
        """Hits of each (segment, shard, block of queries): one task has the wanted postings of a shard and at most about TOGETHER queries."""
        asked = weighted.groupBy("token", "block", *where).agg(F.first("idf").alias("idf"), F.collect_list("query").alias("queries"), F.collect_list("n_wanted").alias("needs"))
        asked = checked_broadcast(cut(asked))
        rows = postings.join(asked, ["token", *where]).select("seg", "shard", "block", "docs", "tfs", "lengths", "idf", "queries", "needs")
        key = ["seg", "shard", "block"]
        if hidden is None:
            return rows.groupBy(*key).applyInArrow(lambda table: _hits(table, None, **settings), HIT)
        away = hidden.select(F.col("seg").alias("seg_"), F.col("shard").alias("shard_"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block_"), "doc")
        return rows.groupBy(*key).cogroup(away.groupBy("seg_", "shard_", "block_")).applyInArrow(lambda left, right: _hits(left, right, **settings), HIT)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and where each row's begin (one more entry than rows)."""
    whole = column.combine_chunks()
    offsets = np.asarray(whole.offsets)
    return np.asarray(whole.flatten()), offsets - offsets[0]


def _hits(table: pa.Table, hidden: pa.Table | None, k: int, by: tuple[str, ...], every_token: bool, mean: float, digits: int) -> pa.Table:
    """Scores of a shard's documents for the queries of a block: a matrix of queries by documents, filled token by token."""
    out: list[tuple] = []
    if len(table):
        docs, first = _lists(table["docs"])
        adds = part_score(np.asarray(table["tfs"].combine_chunks().flatten()).astype(np.float64), np.asarray(table["lengths"].combine_chunks().flatten()), mean)
        asked, begin = _lists(table["queries"])
        names, at = np.unique(docs, return_inverse=True)
        queries, of, which = np.unique(asked, return_index=True, return_inverse=True)
        needs = np.asarray(table["needs"].combine_chunks().flatten())[of]
        score, found = np.zeros((len(queries), len(names))), np.zeros((len(queries), len(names)), np.int32)
        for i, idf in enumerate(table["idf"].to_pylist()):
            cells = np.ix_(which[begin[i] : begin[i + 1]], at[first[i] : first[i + 1]])
            score[cells] += idf * adds[first[i] : first[i + 1]]
            found[cells] += 1
        if hidden is not None:
            found[:, np.isin(names, np.asarray(hidden["doc"]))] = 0
        score = np.round(score, digits)
        for q, name in enumerate(queries.tolist()):
            live = np.flatnonzero(found[q] == needs[q] if every_token else found[q] > 0)
            keep = live
            if not every_token and len(live) > k:
                keep = np.unique(np.concatenate([live[np.lexsort((names[live], -measure[q][live]))[:k]] for c, measure in (("score", score), ("n_tokens", found)) if c in by]))
            out += zip([name] * len(keep), names[keep].tolist(), score[q][keep].tolist(), found[q][keep].tolist(), strict=True)
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["query", "doc", "score", "n_tokens"])


def recall(index: TextIndex, tiers: DataFrame, k: int, query: str = "query_id", scope: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, n_tokens, rank, relaxed) from (query, tiers), ``tiers`` being lists of tokens, the strict one first: documents
    with every token of a query's first tier that has any. No scope at all is no bound; an empty one has no results."""
    ranked = None
    for tier in (0, 1):
        asked = tiers.where(F.size("tiers") > tier).select(query, F.explode(F.col("tiers")[tier]).alias("token"))
        hits = cut(index.search(asked, k, query, every_token=True, scope=scope)).withColumn("relaxed", F.lit(tier > 0))
        ranked = hits if ranked is None else tiered(ranked, hits, query)
    return top_k(ranked, query, [F.desc("score"), F.col("doc")], k)
