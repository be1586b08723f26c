"""BPE encoding and decoding by speculation and verification (operator 10).

Greedy longest match proposes the tokens of every distinct piece of a batch. A
proposal is the result of merging by rank if each token comes out of its own
symbols and each adjacent pair is compatible: while the two tokens are built, no
merge across their border has its turn earlier. That is tested for all adjacent
pairs at once, by undoing the merges at the border from the last to the first.
Only pieces that fail are merged step by step.

Defined results: null and empty texts have no tokens; special tokens standing in
a text are single tokens, as in the library; repeated rows get the same result
each; other columns are left alone; texts have any length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable
from itertools import compress, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, give_back, mix

NEVER = np.iinfo(np.int64).max
#: Pieces with more symbols are merged one by one, by a heap.
LONG = 100
#: White space of Python that the tokenizer takes for symbols.
ODD_SPACE = re.compile("[\x1c-\x1f]")
UNICODE_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Units of these characters alone are normalised and split here; Latin letters that
#: are one code point, one case pair and already composed.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+| ")

Flat = tuple[np.ndarray, np.ndarray]  # ids of all items, and where each begins (one entry more than items)


def gather(flat: np.ndarray, first: np.ndarray, codes: np.ndarray) -> Flat:
    """Items ``codes`` of a flat list, as a flat list."""
    start, size = first[codes], first[codes + 1] - first[codes]
    total = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start - total[:-1], size) + np.arange(total[-1])], total


class Codes(dict):
    """Numbers strings in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


class Memo:
    """Ids of strings met before; at most about ``room`` are remembered, beyond that all are forgotten."""

    def __init__(self, encode: Callable[[list[str]], Flat], room: int):
        self.encode_new, self.room = encode, room
        self.clear()

    def clear(self) -> None:
        self.code = Codes()
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, items: list[str]) -> Flat:
        known = len(self.code)
        if known > self.room:
            self.clear()
            known = 0
        codes = np.fromiter(map(self.code.__getitem__, items), np.int64, len(items))
        if len(self.code) > known:
            ids, first = self.encode_new(list(islice(reversed(self.code), len(self.code) - known))[::-1])
            self.ids, self.first = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.first, first[1:] + len(self.ids)])
        return gather(self.ids, self.first, codes)


class UnitCache:
    """Ids of texts by their white-space separated units, and of these by their pieces.

    ``pieces`` encodes normalised pieces of PLAIN characters, ``units`` encodes units
    with any others; both get what isn't remembered and return flat lists.
    """

    def __init__(self, pieces: Callable[[list[str]], Flat], units: Callable[[list[str]], Flat], special: Iterable[str] = (), room: int = 600_000):
        self.encode_units = units
        self.special = tuple(special)
        self.pieces = Memo(pieces, room)
        self.units = Memo(self._new, room)

    def clear(self) -> None:
        self.pieces.clear()
        self.units.clear()

    def _new(self, new: list[str]) -> Flat:
        full = PLAIN.fullmatch
        plain = [bool(full(u)) and not ("<|" in u and any(s in u for s in self.special)) for u in new]
        found = PIECE.findall(" ".join(compress(new, plain)).lower() + " ") if any(plain) else []
        ends = np.flatnonzero(np.fromiter(map(" ".__eq__, found), bool, len(found)))
        flat, first = self.pieces.encode([p for p in found if p != " "])
        first = first[np.r_[0, ends - np.arange(len(ends))]]
        if len(ends) == len(new):
            return flat, first
        more, ends = self.encode_units([u for u, p in zip(new, plain, strict=True) if not p])
        order = np.argsort(np.r_[np.flatnonzero(plain), np.flatnonzero(~np.array(plain))])
        return gather(np.concatenate([flat, more]), np.concatenate([first, ends[1:] + len(flat)]), order)

    def encode(self, texts: Iterable[str | None]) -> Flat:
        """Ids of all texts and where each text begins."""
        units: list[str] = []
        sizes = [0]
        for text in texts:
            if text:
                units += text.split() if not ODD_SPACE.search(text) else filter(None, UNICODE_SPACE.split(text))
            sizes.append(len(units))
        ids, first = self.units.encode(units)
        return ids, first[np.asarray(sizes)]


#: Two-byte Latin letters as the byte alphabet writes them: the lead byte 0xC3 as itself, a byte from 0x80 on
#: that isn't printable Latin-1 as the character numbered past 255 in the order of such bytes.
_SHIFTED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
LATIN_BYTES = {c: "".join(chr(256 + _SHIFTED.index(b)) if b in _SHIFTED else chr(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Codec:
    """Byte-level BPE with an end-of-word suffix, read from a ``tokenizer.json``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        n = max(*self.vocab.values(), *self.special.values()) + 1
        self.tokens = np.full(n, "", object)
        for k, v in (self.vocab | self.special).items():
            self.tokens[v] = k
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a, b = (np.array([self.vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([self.vocab[m[0] + m[1].removeprefix("##")] for m in merges], np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), a, b
        self.made = made
        pair = a << 32 | b
        self.merge = {(x, y): r for r, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
        self.slots = 1 << 20  # an open hash table of the merges
        slot = self._slot(pair)
        self.key, self.key_rank = np.full(self.slots, -1, np.int64), np.full(self.slots, NEVER)
        self.probes = 0
        left = np.arange(len(pair))
        while len(left):
            at = (slot[left] + self.probes) % self.slots
            put = left[np.unique(at, return_index=True)[1]]
            put = put[self.key[(slot[put] + self.probes) % self.slots] < 0]
            at = (slot[put] + self.probes) % self.slots
            self.key[at], self.key_rank[at] = pair[put], put
            left = np.setdiff1d(left, put)
            self.probes += 1
        self.inner, self.final = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        for k, v in self.vocab.items():
            if len(k) == 1:
                self.inner[ord(k)] = v
            elif len(k) == 1 + len(self.suffix) and k.endswith(self.suffix):
                self.final[ord(k[0])] = v
        self.automaton = ahocorasick.Automaton()
        self.length = np.zeros(n, np.int64)
        for k, v in self.vocab.items():
            word = k.removesuffix(self.suffix) + " " if k.endswith(self.suffix) else k
            self.automaton.add_word(word, v)
            self.length[v] = len(word)
        self.automaton.make_automaton()
        self.sound = np.ones(n, bool)  # tokens that come out of their own symbols
        ok = self.compatible(a, b, np.arange(len(made)))
        for x, y, z, good in zip(a.tolist(), b.tolist(), made.tolist(), ok.tolist(), strict=True):
            self.sound[z] = good and self.sound[x] and self.sound[y]
        if len(set(made.tolist())) < len(made):  # a token with two derivations: nothing is verified, all is merged
            self.sound[:] = False
        self.cache = UnitCache(self._plain, self._units, self.special, room=200_000)
        self.digits = np.array([str(i) for i in range(n)], object)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (mix(pair.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NEVER where there is none."""
        pair = a << 32 | b
        slot, out = self._slot(pair), np.full(len(pair), NEVER)
        for i in range(self.probes):
            at = (slot + i) % self.slots
            out = np.where(self.key[at] == pair, self.key_rank[at], out)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge over the border of tokens a and b has its turn, among the merges below rank ``before``."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.broadcast_to(np.asarray(before, np.int64), len(a)).copy()
        while len(live):
            hit = self.ranks(x, y) < limit
            ok[live[hit]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~hit & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            on_left = rx > ry  # of two equal merges the left one comes first, so the right one is undone first
            limit = np.where(on_left, rx, ry + 1)
            x, y = np.where(on_left, self.right[x], x), np.where(on_left, y, self.left[y])
        return ok

    def propose(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all pieces: tokens, the piece of each, and which pieces are covered whole."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1  # a blank ends each piece and stands for the suffix
        found = np.array([x for m in self.automaton.iter_long(" ".join(pieces) + " ") for x in m], np.int64).reshape(-1, 2)
        own = np.searchsorted(np.cumsum(size), found[:, 0], "right")
        whole = np.bincount(own, self.length[found[:, 1]], len(pieces)) == size
        return found[:, 1], own, whole

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging, of all pieces side by side: in each the pair of least rank, leftmost
        first, until none is left. Returns tokens and the piece of each, in order."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        own = np.repeat(np.arange(len(pieces)), size)
        part = self.inner[chars]
        last = np.cumsum(size) - 1
        part[last] = self.final[chars[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(part):
            rank = np.full(len(part), NEVER)
            pair = np.flatnonzero(own[1:] == own[:-1])
            rank[pair] = self.ranks(part[pair], part[pair + 1])
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(own)]))
            live = least != NEVER
            done.append((part[~live], own[~live]))
            at = np.flatnonzero((rank == least) & live)
            at = at[np.r_[True, own[at][1:] != own[at][:-1]]] if len(at) else at
            part[at] = self.made[rank[at]]
            live[at + 1] = False
            part, own = part[live], own[live]
        tokens, owns = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(owns, kind="stable")
        return tokens[order], owns[order]

    def merged_long(self, piece: str) -> list[int]:
        """Exact merging of one long piece, by a heap of pairs: n log n steps."""
        part = [*self.inner[[ord(c) for c in piece]].tolist()]
        part[-1] = int(self.final[ord(piece[-1])])
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank = lambda i: self.merge.get((part[i], part[after[i]]), NEVER) if after[i] < len(part) else NEVER
        heap = [(r, i) for i in range(len(part)) if (r := rank(i)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) != NEVER:
                    heapq.heappush(heap, (r, k))
        return [x for x in part if x >= 0]

    def _plain(self, pieces: list[str]) -> Flat:
        return self.encode_pieces("\n".join(pieces).translate(LATIN_BYTES).split("\n") if pieces else [])

    def pieces(self, unit: str) -> list[str]:
        """Normalised pieces, in the byte alphabet, of a text without special tokens."""
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(unit))]

    def encode_pieces(self, pieces: list[str]) -> Flat:
        """Tokens of pieces in the byte alphabet."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        flat, own, whole = self.propose(pieces)
        bad = ~whole
        bad[own[~self.sound[flat]]] = True
        inner = np.flatnonzero(own[1:] == own[:-1])
        pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[own[inner[~ok[which]]]] = True
        keep = ~bad[own]
        flat, own = flat[keep], own[keep]
        again = np.flatnonzero(bad)
        long = [i for i in again.tolist() if len(pieces[i]) > LONG]
        if len(again) > len(long):
            short = again[[len(pieces[i]) <= LONG for i in again.tolist()]]
            tokens, at = self.merged([pieces[i] for i in short.tolist()])
            flat, own = np.concatenate([flat, tokens]), np.concatenate([own, short[at]])
        for i in long:
            tokens = np.array(self.merged_long(pieces[i]), np.int64)
            flat, own = np.concatenate([flat, tokens]), np.concatenate([own, np.full(len(tokens), i)])
        order = np.argsort(own, kind="stable")
        return flat[order], np.searchsorted(own[order], np.arange(len(pieces) + 1))

    def _units(self, units: list[str]) -> Flat:
        plan: list[list[int]] = []  # of each unit: numbers of pieces, or -1 - the id of a special token
        wanted: dict[str, int] = {}
        for u in units:
            plan.append(mine := [])
            for x in self.split_special.split(u) if self.split_special else [u]:
                if x in self.special:
                    mine.append(-1 - self.special[x])
                elif x:
                    mine += [wanted.setdefault(p, len(wanted)) for p in self.pieces(x)]
        flat, first = self.encode_pieces(list(wanted))
        special = np.array(sorted(self.special.values()), np.int64)
        place = {int(v): len(wanted) + i for i, v in enumerate(special)}
        flat, first = np.concatenate([flat, special]), np.concatenate([first, first[-1] + 1 + np.arange(len(special))])
        codes = np.array([k if k >= 0 else place[-1 - k] for mine in plan for k in mine], np.int64)
        ids, first = gather(flat, first, codes)
        return ids, first[np.concatenate([[0], np.cumsum([len(m) for m in plan])])]

    def encode(self, texts: Iterable[str | None]) -> Flat:
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by one blank, as the library does for a file without a decoder."""
        return " ".join(self.tokens[ids].tolist())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, once a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def tokenizer_path(name: str) -> str:
    """Resolved where the code runs: each machine has the file in its own place."""
    import public_tokenizers

    return public_tokenizers.path(name)


BATCH = 4 << 20


def bpe_encode(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, ids): token ids of each text."""

    def run(batches):
        c = codec(tokenizer_path(name))
        for table in chunks(batches, BATCH):
            ids, first = c.encode(table["text"].to_pylist())
            lists = pa.LargeListArray.from_arrays(pa.array(first), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        c = codec(tokenizer_path(name))
        for batch in batches:
            texts = [None if x is None else c.decode(np.asarray(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digest(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """Encoding and decoding of each text in one pass, as digests of both."""

    def run(batches):
        c = codec(tokenizer_path(name))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for table in chunks(batches, BATCH):
            ids, first = c.encode(table["text"].to_pylist())
            each = [ids[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks(), pa.array(np.diff(first), pa.int64()),
                pa.array([sha(" ".join(c.digits[x].tolist())) for x in each], pa.string()), pa.array([sha(c.decode(x)) for x in each], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.cache.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)
