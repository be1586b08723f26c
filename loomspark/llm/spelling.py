"""Spelling variants of frequent words by asymmetric chunks (operator 12).

Words are runs of Latin letters of a corpus, counted per task before they are shuffled. Two words
are near if one edit (a code point inserted, deleted or replaced) makes one of the other. Of such
a pair the shorter word (of equal ones the smaller) is cut into two disjoint chunks; one edit leaves
one of them as it is, and that chunk stands in the other word as a positional gram, within a shift
of one: the first chunk at its own place, the second moved by the difference of the lengths. So
every word contributes its two chunks and, for each length that its partner may have, the grams
at the places where these may stand; a join on (length, chunk's number, text) gives candidates, and
the edit distance confirms them inside the join. A pair that shares both chunks counts by its
first one, so no pair comes twice.

Chunks that very many words share (``crowded``) are not joined as they are: the half that may hold
the edit is cut in two again, and one of these quarters is also unchanged. The work of a chunk then
falls by the number of different quarters, and no pair is lost.

Defined results: null texts have no words, a null doc_id counts as an empty text in the spelling
key; equal rows count each; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, chunks, keep

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RUN, SHORTEST = "A-Za-zÀ-ÿ", 7


def respelled(word: str, key: int) -> str:
    """The contract's noise: where 31 divides ``key``, ``word`` without the code point at ``key`` modulo its length."""
    if key % 31:
        return word
    at = key % len(word)
    return word[:at] + word[at + 1 :]


def occurrences(docs: DataFrame, shortest: int = SHORTEST, change: Callable[[str, int], str] | None = respelled, entries: int = 200_000) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points with their counts, partial ones of each task.
    ``change(word, crc32 of doc_id:word)`` may respell a word; at most ``entries`` words are held at once."""

    def run(batches):
        runs, counts = re.compile(f"[{RUN}]{{{shortest},}}"), Counter()  # a maximal run, as it can't begin later

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for table in chunks(batches, 1 << 20):
            for doc, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True):
                if not text:
                    continue
                found = Counter(runs.findall(text.encode().translate(_LOWER).decode()))
                if change is None:
                    counts.update(found)
                else:
                    begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in found.items():
                        word = change(word, zlib.crc32(word.encode(), begun))
                        if len(word) >= shortest:
                            counts[word] += n
                if len(counts) >= entries:
                    yield out()
        if counts:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def _letters(word: Column) -> Column:
    """A bit for each letter (modulo 64): one edit changes two bits at most."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def near_pairs(words: DataFrame, cut: Scratch, crowded: int = 512) -> DataFrame:
    """(a, b): each unordered pair of near words once, from (word) without repeats."""
    length = F.char_length("word")
    base = words.select("word", length.alias("len"), _letters(F.col("word")).alias("letters"))
    half = F.floor(F.col("of") / 2).cast("int")
    piece = lambda at, n: F.substring(F.col("word"), at + 1, n)
    sides = F.array(F.lit(1), F.lit(2))

    # The shorter word, of length ``of``, has its two chunks; the other one, longer by ``more``, the grams that these may be.
    short = base.withColumn("of", F.col("len")).withColumn("more", F.lit(0)).withColumn("side", F.explode(sides))
    long = base.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("of", F.col("len") - F.col("more")).withColumn("side", F.explode(sides))

    def keyed(rows: DataFrame) -> DataFrame:
        text = F.when(F.col("side") == 1, piece(F.lit(0), half)).otherwise(piece(half + F.col("more"), F.col("of") - half))
        return rows.withColumn("key", F.xxhash64("of", "side", text))

    short, long = keyed(short), keyed(long)
    tally = short.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key", F.lit(True).alias("crowd"))
    crowds = cut(tally)

    def refined(rows: DataFrame) -> DataFrame:
        """Crowded keys with a quarter of the other half; others as they are (quarter 0)."""
        marked = rows.join(crowds, "key", "left").withColumn("quarter", F.explode(F.when(F.col("crowd"), sides).otherwise(F.array(F.lit(0)))))
        begin = F.when(F.col("side") == 1, half).otherwise(F.lit(0))  # the half that may hold the edit
        size = F.when(F.col("side") == 1, F.col("of") - half).otherwise(half)
        first = F.floor(size / 2).cast("int")
        text = F.when(F.col("quarter") == 1, piece(begin, first)).otherwise(piece(begin + first + F.col("more"), size - first))
        return marked.withColumn("key", F.when(F.col("quarter") == 0, F.col("key")).otherwise(F.xxhash64("key", "quarter", text)))

    a = refined(short).select("key", F.col("word").alias("a"), F.col("letters").alias("x"), F.col("side").alias("sa"), F.col("quarter").alias("qa"), F.col("of").alias("of"))
    b = refined(long).select("key", F.col("word").alias("b"), F.col("letters").alias("y"), F.col("side").alias("sb"), F.col("quarter").alias("qb"), F.col("more").alias("more"))
    near = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2) & ((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.col("sa") == F.col("sb")) & (F.col("qa") == F.col("qb"))
    same = lambda at_a, at_b, n: F.substring(F.col("a"), at_a + 1, n) == F.substring(F.col("b"), at_b + 1, n)
    begin = F.when(F.col("sa") == 1, half).otherwise(F.lit(0))
    quarter = F.floor(F.when(F.col("sa") == 1, F.col("of") - half).otherwise(half) / 2).cast("int")
    once = (same(F.lit(0), F.lit(0), half) == (F.col("sa") == 1)) & ((F.col("qa") == 0) | (same(begin, begin, quarter) == (F.col("qa") == 1)))
    return a.join(b, (a["key"] == b["key"]) & near & (F.levenshtein(F.col("a"), F.col("b"), 1) == 1) & once).select("a", "b")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, factor: int = 10, change: Callable[[str, int], str] | None = respelled, crowded: int = 512) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words with at least ``least`` occurrences.

    ``form`` is the near word of most occurrences (of equal ones the smallest) if it has ``factor`` times
    the word's; ``root`` is where the forms lead to. Counts rise by ``factor`` along forms, so they end.
    """
    with Scratch(docs.sparkSession) as cut:
        words = cut(occurrences(docs, shortest, change).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        pairs = cut(near_pairs(words.select("word"), cut, crowded))
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
        counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("of")), "near")
        best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("of")).alias("less"), "near")).alias("best"))
        found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
        found = found.withColumn("form", F.when(F.col("form_n") >= factor * F.col("n"), F.col("best.near")))
        found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")))
        ahead, table = found.where("form is not null").select("word", F.col("form").alias("root")), None
        while True:  # pointer doubling: as many rounds as the logarithm of the longest chain
            further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
            step = cut(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            cut.drop(table)
            ahead, table = step.select("word", "root"), step
            if step.where("moved").isEmpty():
                break
        return keep(found.join(ahead, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
