"""Benchmark decontamination by q-gram filtering (operator 2).

An item of ``m`` characters that occurs in a text with at most ``e`` edits shares
``m - q + 1 - q * e`` q-grams with it, on diagonals at most ``e`` apart (q-gram
lemma). Texts are scanned for the items' q-grams; stretches with too few of them for
any item are passed over; in the rest, hits are counted for each item in overlapping
bands of ``2 (e + 1)`` diagonals, and bands that reach the item's bound are verified
by a banded alignment of the whole item against the text.

The benchmark is a small table by nature: it is broadcast up to ``MAX_ITEM_CHARS``
characters, and beyond that worked through in tiles of as many, each a pass over the
documents. Documents never move.

Letters' case and the kind of white space don't count as edits. Defined results: null
and empty texts contain nothing; null items and items of fewer than ``q`` characters
are no evidence and are passed over; repeated rows give one row each; equal ids of
items keep one row for each text found; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, mix

Q = 10
MAX_ITEM_CHARS = 16 << 20
_TABLE_BITS = 22
#: Of a key of item and band: bands lie below 2**41, items below 2**21 (a tile has fewer, of Q characters or more).
_BAND_BITS = 41
_MOST_ITEMS = 1 << 62 - _BAND_BITS
_FOLD = np.arange(0x3000, dtype=np.uint32)
for _i in range(0x3000):
    if len(chr(_i).lower()) == 1:
        _FOLD[_i] = ord(chr(_i).lower())
    if chr(_i).isspace():
        _FOLD[_i] = 0x20
_END = np.uint32(0x110000)  # no character
SCHEMA = "doc_id long, item_id long, start int, end int, edits int"


def folded(text: str) -> np.ndarray:
    """Code points, lower-cased one by one, white space as blanks."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that begins at each position."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = points.astype(np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + n]
    return mix(out)


class Items:
    """The q-grams of a tile of the benchmark."""

    def __init__(self, ids: list[int], texts: list[str], error: float, q: int = Q):
        self.q = q
        kept = [(i, p) for i, p in ((i, folded(t)) for i, t in zip(ids, texts, strict=True)) if len(p) >= q]
        self.ids = [i for i, _ in kept]
        self.points = [p for _, p in kept]
        if len(kept) > _MOST_ITEMS:
            raise ValueError(f"a tile holds {len(kept)} items, at most {_MOST_ITEMS} fit")
        size = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.minimum((size * error).astype(np.int64), np.maximum(0, (size - q) // q))  # the bound stays above 0
        self.bound = size - q + 1 - q * self.edits
        self.size = size
        g = [grams(p, q) for p in self.points]
        flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.item = np.repeat(np.arange(len(g)), [len(x) for x in g])[order]
        self.at = np.concatenate([np.arange(len(x)) for x in g])[order] if g else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[(flat >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        # Stretches are judged by classes of lengths, a factor of two each: the least bound within the greatest length.
        self.classes = []
        for k in np.unique(np.floor(np.log2(size))) if len(size) else ():
            mine = np.floor(np.log2(size)) == k
            self.classes.append((int((size + self.edits)[mine].max()), int(self.bound[mine].min())))

    def candidates(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that reach their item's bound."""
        g = grams(points, self.q)
        none = np.zeros(0, np.int64)
        if not len(g) or not len(self.gram):
            return none, none
        hit = np.flatnonzero(self.seen[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.gram, g[hit]), len(self.gram) - 1)
        hit = hit[self.gram[slot] == g[hit]]
        if not len(hit):
            return none, none
        keep = np.zeros(len(hit), bool)
        for length, bound in self.classes:  # hit i opens a stretch if its bound-th follower is near enough
            if len(hit) >= bound:
                opens = np.flatnonzero(hit[bound - 1 :] - hit[: len(hit) - bound + 1] < length)
                change = np.zeros(len(hit) + 1, np.int64)
                np.add.at(change, opens, 1)
                np.add.at(change, np.searchsorted(hit, hit[opens] + length), -1)
                keep |= np.cumsum(change[:-1]) > 0
        hit = hit[keep]
        lo, hi = np.searchsorted(self.gram, g[hit], "left"), np.searchsorted(self.gram, g[hit], "right")
        count = hi - lo
        slot = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(hit) else none
        item = self.item[slot]
        diagonal = np.repeat(hit, count) - self.at[slot]
        width = self.edits[item] + 1
        band = (diagonal + (1 << 40)) // width  # each diagonal lies in two bands
        both = np.concatenate([item << _BAND_BITS | band, item << _BAND_BITS | (band - 1)])
        key, n = np.unique(both, return_counts=True)
        item = key >> _BAND_BITS
        good = n >= self.bound[item]
        item, band = item[good], (key & (1 << _BAND_BITS) - 1)[good]
        return item, band * (self.edits[item] + 1) - (1 << 40)

    def align(self, points: np.ndarray, item: int, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits, start and end of the best alignment in each band of an item."""
        p, e = self.points[item], int(self.edits[item])
        m, width = len(p), 4 * e + 3  # a path may leave the band by e diagonals on either side
        first = diagonals - e
        at = first[:, None] + np.arange(m + width)
        text = np.where((at >= 0) & (at < len(points)), points[np.clip(at, 0, len(points) - 1)], _END)
        cost = np.zeros((len(diagonals), width + 1), np.int32)
        cost[:, width] = 1 << 20
        begin = np.broadcast_to(first[:, None] + np.arange(width + 1), cost.shape).astype(np.int64)
        step = np.arange(width + 1, dtype=np.int32)
        rows = np.arange(len(diagonals))[:, None]
        for i in range(m):
            change = cost[:, :-1] + (text[:, i : i + width] != p[i])
            skip = cost[:, 1:] + 1
            new = np.where(change <= skip, change, skip)
            origin = np.where(change <= skip, begin[:, :-1], begin[:, 1:])
            low = np.minimum.accumulate(new - step[:width], axis=1)
            source = np.maximum.accumulate(np.where(new - step[:width] == low, step[:width], 0), axis=1)
            cost[:, :width] = low + step[:width]
            begin = np.concatenate([origin[rows, source], begin[:, width:]], axis=1)
        best = cost[:, :width].argmin(axis=1)
        r = np.arange(len(diagonals))
        return cost[r, best], np.maximum(begin[r, best], 0), np.minimum(first + m + best, len(points))

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the best occurrence of each item that the text contains."""
        if not text or not self.ids:
            return []
        return self._found(folded(text), 0)

    def _found(self, points: np.ndarray, offset: int) -> list[tuple[int, int, int, int]]:
        item, diagonal = self.candidates(points)
        out = []
        for k in np.unique(item).tolist():
            edits, start, end = self.align(points, k, diagonal[item == k])
            if (best := np.lexsort((start, edits))[0]) >= 0 and edits[best] <= self.edits[k]:
                out.append((self.ids[k], int(start[best]) + offset, int(end[best]) + offset, int(edits[best])))
        return out


def _tiles(benchmark: DataFrame):
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.length("text").cast("long").alias("n"))
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // MAX_ITEM_CHARS))
    for k in range(parts):
        yield rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = 0.06) -> DataFrame:
    """(doc_id, item_id, start, end, edits): items found in documents with at most ``error * length`` edits."""
    out = None
    for tile in _tiles(benchmark):
        rows = tile.select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches, shared=shared):
            items = Items(*shared.value, error)
            for table in chunks(batches, 1 << 20):
                found = []
                for doc_id, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True):
                    found += [(doc_id, *f) for f in items.find(text)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, error: float = 0.06) -> DataFrame:
    """``docs``, all columns, without the rows whose text contains an item. Nothing is joined or shuffled."""
    for tile in _tiles(benchmark):
        rows = tile.select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches, shared=shared):
            items = Items(*shared.value, error)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not items.find(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
