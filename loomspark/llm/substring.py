"""Removal of passages that repeat across documents (operator 5).

Every window of ``size`` words gets two Rabin-Karp hashes (modulo 2**61 - 1, independent
bases) on the executors; a window's name is 61 bits of the first and 32 of the second.
Windows meet in buckets of the hash space: each block of documents sends every
bucket one packed row, in which a window that repeats inside the block is already
settled, so a window that a third of all documents share costs one entry a block.
A bucket counts the hashes it has got, and answers each block with the windows
that also start in a document of smaller id. Windows merge into maximal intervals.

Defined results: null texts have no words; rows with a null ``doc_id`` neither
lend nor lose words; equal ids are one document; repeated rows get the same
result each; other columns are left alone. Two different windows get one name with a
chance of about ``size`` squared times 2**-93 a pair, whatever their words are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Words, chunks, packed_texts, unpacked, window_hashes

SEED = 50_001
SENT = "bucket int, block long, hashes binary, more binary, at binary, counts binary, ids binary, first binary, keys binary"
INTERVALS = "doc_id long, h long, starts array<int>, ends array<int>"


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which the shuffle's compression shrinks if neighbours are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _alike(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which windows of one name stand together (in their order), and where each name begins in it."""
    by = np.argsort(h, kind="stable")
    new, other = h[by][1:] != h[by][:-1], more[by][1:] != more[by][:-1]
    if (~new & other).any():
        by = np.lexsort((more, h))
        new, other = h[by][1:] != h[by][:-1], more[by][1:] != more[by][:-1]
    return by, np.flatnonzero(np.r_[True, new | other]) if len(h) else by


def _marked(table: pa.Table, size: int, bits: int, block: int):
    """One row for each bucket, and one (bucket -1 - block) with what is settled within the block."""
    ids = np.asarray(table["doc_id"])
    order = np.argsort(ids, kind="stable")
    ids, keys = ids[order], np.asarray(table["h"])[order]
    words = Words(table["text"].combine_chunks().take(pa.array(order)))
    at, h, more = window_hashes(words, size, SEED)
    more = (more >> np.uint64(32)).astype(np.uint32)
    doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
    by, same = _alike(h, more)
    least = np.empty(len(h), np.int64)
    least[by] = np.repeat(ids[doc[by[same]]], np.diff(np.r_[same, len(h)]))
    settled = ids[doc] > least if len(h) else np.zeros(0, bool)
    yield -1, at[settled].astype(np.uint32), None, None, None, ids, words.first.astype(np.uint32), keys
    at, h, more, doc = at[~settled].astype(np.uint32), h[~settled], more[~settled], doc[~settled]
    bucket = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(h), np.uint16)
    by = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]]) if len(by) else by
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(by)], strict=False):
        take = by[i:j]  # ascending in at and so in doc
        own, counts = np.unique(doc[take], return_counts=True)
        yield int(bucket[take[0]]), np.diff(at[take], prepend=np.uint32(0)), h[take], more[take], counts.astype(np.uint32), ids[own], None, None


def _send(size: int, bits: int, block_bytes: int):
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for table in chunks(batches, block_bytes):
            block = part * 2**24 + n
            n += 1
            rows = list(_marked(table, size, bits, block))
            pack = lambda i: [None if r[i] is None else _planes(r[i]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] if r[0] >= 0 else block % 2**bits for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                *(pa.array(pack(i), pa.binary()) for i in (2, 3, 1, 4, 5, 6, 7)),  # the bytes of a hash that name the bucket are one plane of one value
            ], ["bucket", "block", "hashes", "more", "at", "counts", "ids", "first", "keys"])

    return run


ANSWER = "block long, at binary, ids binary, first binary, keys binary"


def _count(table: pa.Table) -> pa.Table:
    """A bucket: which windows occur in a document of smaller id."""
    rows = table.to_pylist()
    sent = [r for r in rows if r["first"] is None]
    out = [{k: r[k] for k in ("block", "at", "ids", "first", "keys")} for r in rows if r["first"] is not None]
    if sent:
        h, more = (np.concatenate([_unplanes(r[c], t) for r in sent]) for c, t in (("hashes", np.uint64), ("more", np.uint32)))
        doc = np.concatenate([np.repeat(_unplanes(r["ids"], np.int64), _unplanes(r["counts"], np.uint32)) for r in sent])
        by, same = _alike(h, more)
        least = np.repeat(np.minimum.reduceat(doc[by], same), np.diff(np.r_[same, len(h)]))
        gone = np.zeros(len(h), bool)
        gone[by] = doc[by] > least
        begin = 0
        for r in sent:
            at = np.cumsum(_unplanes(r["at"], np.uint32), dtype=np.uint32)
            if (at := at[gone[begin : (begin := begin + len(at))]]).size:
                out.append({"block": r["block"], "at": _planes(at), "ids": None, "first": None, "keys": None})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("at", "ids", "first", "keys"))]))


def _merge(size: int):
    """A block's windows as maximal intervals of each document's words."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["first"] is not None)
        ids, first, keys = _unplanes(head["ids"], np.int64), _unplanes(head["first"], np.uint32).astype(np.int64), _unplanes(head["keys"], np.int64)
        at = np.sort(np.concatenate([_unplanes(r["at"], np.uint32) for r in rows]).astype(np.int64))
        doc = np.searchsorted(first, at, "right") - 1
        new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + size)] if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        begin, end = at[begin] - first[doc[begin]], at[np.r_[begin[1:] - 1, len(at) - 1]] + size - first[doc[begin]] if len(at) else begin
        doc = doc[new]
        own = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[own, len(doc)], pa.int32()), pa.array(x, pa.int32()))
        return pa.table({"doc_id": pa.array(ids[doc[own]], pa.int64()), "h": pa.array(keys[doc[own]], pa.int64()), "starts": lists(begin), "ends": lists(end)})

    return run


def repeated_intervals(docs: DataFrame, size: int = 50, bucket_bytes: int = 6 << 20, block_bytes: int = 2 << 20, most_block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, h, starts, ends): maximal runs of words to remove; ``h`` is ``xxhash64(text)``.

    ``bucket_bytes``: about as many bytes of text meet in one bucket, so a
    bucket's memory stays the same at any size of the corpus. Blocks of ``block_bytes``
    grow with the number of buckets up to ``most_block_bytes``, so that a packed row holds
    many windows; a block sends a bucket nothing where it has no window for it, so beyond
    that size rows are as many as windows at most.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    spread = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = spread.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = min(30, max(0, int(np.ceil(np.log2(max(1, total / bucket_bytes))))))
    block = max(block_bytes, min(most_block_bytes, 2**bits * 4096))
    sent = spread.withColumn("h", F.xxhash64("text")).mapInArrow(_send(size, bits, block), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_count, ANSWER)
    return answers.groupBy("block").applyInArrow(_merge(size), INTERVALS).dropDuplicates(["doc_id", "h"])


def _kept(batches):
    for table in chunks(batches, 2 << 20):
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        for doc_id, text, starts, ends in zip(table["doc_id"].to_pylist(), unpacked(table["text"].to_pylist()), table["starts"].to_pylist(), table["ends"].to_pylist(), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            for s, e in zip(reversed(starts or ()), reversed(ends or ()), strict=True):
                del words[s:e]
            out["doc_id"].append(doc_id)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept"].append(b" ".join(words).decode())
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))


def with_intervals(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, text, starts, ends) for each row of ``docs``; texts are packed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    return packed_texts(docs).join(repeated_intervals(docs, size), ["doc_id", "h"], "left").select("doc_id", "text", "starts", "ends")


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` joins the words that stay by one blank."""
    return with_intervals(docs, size).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def _digests(batches):
    for batch in _kept(batches):
        kept = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_removed")), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_digest(docs: DataFrame, size: int = 50) -> DataFrame:
    """:func:`remove_repeats` with a digest in place of the text."""
    return with_intervals(docs, size).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
