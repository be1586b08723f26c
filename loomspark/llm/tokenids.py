"""Token ids of a corpus in a binary format (operator 1).

A segment holds the concatenated ids of consecutive documents and the documents'
boundaries as an Elias-Fano code: the low ``l`` bits of each boundary packed, the
rest in unary, ``2 + l`` bits a document where ``l = log2(ids / documents)``. A
sample of every 256th one bit makes ``select`` (a document's offset) a look-up and
a short scan. No table of 64-bit offsets is kept.

Layout of a segment, little-endian: ``LTOK``, version (u16), bytes an id (u16),
documents (u64), ids (u64), ids of the same part before it (u64), low bits (u8),
bytes of nulls, doc ids, low, high, samples (5 x u64), then these five arrays and the
ids. Segments are rows of a Parquet table (part, seq, payload), written by Spark's
committer, so a lost executor or a repeated task leaves whole files. Parts are
ranges of doc_id in ascending order, segments within a part are ascending too.

Defined results: null and empty texts have only the end id; null ids come first;
equal ids are ordered by their texts; repeated rows are kept; other columns are
left alone. A document is never split, so a segment holds one document at least.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import BATCH, Flat, UnitCache, tokenizer_path
from .common import chunks, shared_folder

HEAD = struct.Struct("<4sHHQQQB5Q")
SAMPLE = 256
SEGMENT_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits and n:
            low = np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32).tobytes())

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, bytes of ones are counted up to its one bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = struct.unpack_from("<I", self.samples, i // SAMPLE * 4)[0]
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] & 0xFF << at % 8 & 0xFF
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little") >> first % 8 & (1 << self.low_bits) - 1
        return position - i << self.low_bits | low

    def __len__(self) -> int:
        return self.n


def pack(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, bounds: np.ndarray, before: int, width: int) -> bytes:
    ef = EliasFano.encode(bounds)
    parts = [np.packbits(nulls).tobytes(), doc_ids.astype("<i8").tobytes(), ef.low, ef.high, ef.samples]
    head = HEAD.pack(b"LTOK", 1, width, len(doc_ids), len(ids), before, ef.low_bits, *map(len, parts))
    return b"".join([head, *parts, ids.astype(f"<u{width}").tobytes()])


class Segment:
    """A segment's documents; ``offset`` and ``ids`` read one of them without decoding the rest."""

    def __init__(self, payload: bytes):
        magic, version, width, self.n, self.n_ids, self.before, bits, *sizes = HEAD.unpack_from(payload)
        if magic != b"LTOK" or version != 1:
            raise ValueError("not a token segment")
        at, parts = HEAD.size, []
        for s in sizes:
            parts.append(payload[at : at + s])
            at += s
        self.nulls = np.unpackbits(np.frombuffer(parts[0], np.uint8))[: self.n].astype(bool)
        self.doc_ids = np.frombuffer(parts[1], "<i8")
        self.bounds = EliasFano(self.n + 1, bits, *parts[2:])
        self.flat = np.frombuffer(payload, f"<u{width}", self.n_ids, at)

    def offset(self, i: int) -> int:
        return self.bounds.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.offset(i) : self.offset(i + 1)]


class LibraryUnits:
    """Units and pieces of texts encoded by the tokenizers library. A special
    token stands between them: the library treats what is between two of them alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.special = list(special)
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        self.vocab_size = self.library.get_vocab_size()
        tokens = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.vocab_size + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith(self.library.model.end_of_word_suffix)]] = True
        self.cache = UnitCache(self.pieces, self.units, self.special)

    def pieces(self, items: list[str]) -> Flat:
        """Normalised pieces: each ends with a token that has the end-of-word suffix."""
        flat = np.array(self.library.encode_batch_fast([" ".join(items)], add_special_tokens=False)[0].ids, np.int64)
        return flat, np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])

    def between_marks(self, items: list[str]) -> Flat:
        """Items without special tokens."""
        if not items:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        flat = np.array(self.library.encode_batch_fast([self.mark.join(items) + self.mark], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.concatenate([[0], ends - np.arange(len(ends))])

    def units(self, units: list[str]) -> Flat:
        alone = [any(s in u for s in self.special) for u in units]
        flat, first = self.between_marks([u for u, a in zip(units, alone, strict=True) if not a])
        if not any(alone):
            return flat, first
        rest = iter(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        each = [np.array(self.library.encode(u, add_special_tokens=False).ids, np.int64) if a else flat[slice(*next(rest))] for u, a in zip(units, alone, strict=True)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


_UNITS: dict[str, LibraryUnits] = {}


def library_units(path: str) -> LibraryUnits:
    if path not in _UNITS:
        _UNITS[path] = LibraryUnits(path)
    return _UNITS[path]


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", end_id: int = 1, parts: int | None = None) -> None:
    """Encode each text, append ``end_id`` and write the segments to ``folder``."""
    spark = docs.sparkSession

    def run(batches):
        units = library_units(tokenizer_path(name))
        width = 2 if max(units.vocab_size, end_id + 1) <= 1 << 16 else 4
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def segment():
            nonlocal held, seq, before
            doc_ids, nulls, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            payload = pack(doc_ids, nulls, ids, np.concatenate([[0], np.cumsum(sizes)]), before, width)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([len(sizes)]), pa.array([len(ids)]), pa.array([payload], pa.binary())], ["part", "seq", "n_docs", "n_ids", "payload"])
            held, seq, before = [], seq + 1, before + len(ids)
            return row

        for table in chunks(batches, BATCH):
            ids, first = units.cache.encode(table["text"].to_pylist())
            ids = np.insert(ids, first[1:], end_id)
            doc_id = table["doc_id"].combine_chunks()
            held.append((np.asarray(doc_id.fill_null(0)), np.asarray(doc_id.is_null()), ids, np.diff(first) + 1))
            if sum(len(h[2]) for h in held) >= SEGMENT_IDS:
                yield segment()
        if held:
            yield segment()

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows.mapInArrow(run, "part long, seq long, n_docs long, n_ids long, payload binary").write.mode("overwrite").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, emit, schema: str) -> DataFrame:
    """``emit(segment, start)`` of each segment as rows; ``start``: ids in all segments before it.

    What is broadcast has a row for each part (the range partitions chosen when
    writing), not for each segment or document.
    """
    segments = spark.read.parquet(folder)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")

    def run(batches):
        for batch in batches:
            for payload, base in zip(batch.column("payload"), batch.column("base").to_pylist(), strict=True):
                s = Segment(payload.as_py())
                yield emit(s, base + s.before)

    return segments.select("part", "payload").join(F.broadcast(parts), "part").select("payload", "base").mapInArrow(run, schema)


def _rows(s: Segment, start: int) -> pa.RecordBatch:
    bounds = s.bounds.decode()
    crc = [zlib.crc32(s.flat[i:j].astype("<u4").tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.nulls), pa.array(bounds[:-1] + start, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(docs: DataFrame, folder: str | None = None, name: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write ``docs`` to ``folder`` (a new one in the shared folder if none is given), and read per document:
    doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, name, end_id)
    return read_tokens(docs.sparkSession, folder, _rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
