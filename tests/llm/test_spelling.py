"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from loomspark.llm import spelling
from loomspark.llm.common import Scratch


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [] for w in words}
    for a, b in itertools.combinations(sorted(words), 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root


def found(df, **settings):
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **settings).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


@pytest.fixture(scope="module")
def misspelt():
    """Few stems with many one-edit variants, chains of ever rarer forms, letters beyond ASCII, and nulls."""
    rng = random.Random(12)
    stems = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (7, 7, 8, 8, 9, 11, 12, 15)] + ["ÀÉÎõüÿß×", "aaaaaaaa", "abababab"]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])

    texts = []
    for k in range(60):
        words = [rng.choice(stems) for _ in range(120)]
        words += [w for v in (changed(rng.choice(stems)) for _ in range(12)) for w in [v] * rng.randint(1, 3)]
        words += [changed(changed(rng.choice(stems))) for _ in range(3)] * 2
        rng.shuffle(words)
        texts.append(rng.choice([" ", "\n", "1", ", ", "中"]).join(w if rng.random() < 0.8 else w.upper() for w in words))
    chain = ["forgetting"] * 1500 + ["forgeting"] * 120 + ["forgetin"] * 10
    return [*texts, " ".join(chain), None, "", "a b", "x" * 40_000, texts[0], (None, texts[1]), (3, texts[2])]


@pytest.mark.parametrize("crowded", [512, 4, 0])
def test_variants_equal_brute_force(frame, misspelt, crowded):
    df = frame(misspelt)
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=repr)
    got = found(df, crowded=crowded)
    assert got == want
    assert any(r[5] != r[3] and r[3] for r in got)  # a chain of forms


def test_documents_equal_brute_force(frame, corpus):
    df = frame(corpus)
    assert found(df) == sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=repr)


def test_empty_table(frame):
    assert found(frame([])) == []


def test_pairs_come_once(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for crowded in (0, 30, 10_000):
        with Scratch(spark) as cut:
            got = [tuple(sorted(r)) for r in spelling.near_pairs(df, cut, crowded).collect()]
        assert sorted(got) == sorted(p for p in itertools.combinations(words, 2) if one_edit(*p))


def test_words_need_no_noise(frame):
    df = frame(["recommend recommend recomend", "recomend " + "recommend " * 20])
    assert found(df, change=None) == [("recomend", 2, 1, "recommend", 22, "recommend"), ("recommend", 22, 1, None, None, "recommend")]
