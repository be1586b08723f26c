import random

import pytest

CLASH = ["h", "n", "cls", "path", "key", "at", "start", "grp"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def rows_of(texts, first=0):
    return [(i + first if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], None if i % 3 else "en", *[c for c in CLASH]) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts):
        return spark.createDataFrame(rows_of(texts), SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty, very long, repeated and nearly repeated ones, and null and equal ids."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeiorst") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = ["\n".join(line(rng.randint(3, 14)) for _ in range(rng.randint(1, 12))) for _ in range(25)]
    passage = line(70)
    texts = [None, "", " ", "one", "One", "a b", *base, None, ""]
    for i in range(8):
        words = base[i].split(" ")
        words[len(words) // 2] = "Changed"
        texts.append(" ".join(words))
    texts += [base[0], base[0], base[3] + "\n" + passage, passage + " tail", passage, "x" + passage, line(6000), "z" * 50_000, "tab\tand\x0bother\x0cspaces\r\nhere\xa0nbsp é É ß ünïcode 中文 \U0001f600"]
    return [*texts, (None, base[1]), (None, None), (7, "equal id"), (7, base[2]), (9, base[3]), (9, base[3])]
