"""Operators that compare documents, lines, shards and vectors, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import ann, groups, lines, neardup, sharding
from loomspark.llm.common import components


def rows(df):
    return [tuple(r) for r in df.collect()]


def shingle_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near_brute(docs, size, percent):
    sets = [shingle_set(t, size) for _, t in docs]
    real = [i for i, (d, _) in enumerate(docs) if d is not None and sets[i]]
    links = [(i, j) for k, i in enumerate(real) for j in real[:k] if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(len(docs), links)
    least = {}
    for i in real:
        least[root[i]] = min(least.get(root[i], docs[i][0]), docs[i][0])
    for i, (d, _) in enumerate(docs):
        c = least[root[i]] if i in set(real) else d
        yield d, len(sets[i]), c, d == c


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(frame, corpus, size):
    df = frame(corpus)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = [r[:4] for r in rows(neardup.near_duplicates(df, size))]
    assert sorted(got, key=repr) == sorted(near_brute(docs, size, 80), key=repr)
    kept = neardup.without_near_duplicates(df, size)
    assert kept.columns == df.columns
    stays = [row for row, w in zip(docs, near_brute(docs, size, 80), strict=True) if w[3]]
    want = [r for r in stays if r[0] is None] + list({r for r in stays if r[0] is not None})
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_of_rows_equal_in_id_and_text_one_stays(spark):
    data = [(1, "a b c d e f", "en"), (1, "a b c d e f", "fr"), (None, "a b c d e f", "en"), (None, "a b c d e f", "en"), (1, "other words are in here", "de")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = [rows(neardup.without_near_duplicates(df.repartition(n))) for n in (1, 3)]
    assert sorted(got[0], key=repr) == sorted(got[1], key=repr)
    assert len(got[0]) == 4 and sum(r[0] is None for r in got[0]) == 2


def thue_morse(n):
    """Two strings of 2**n letters that every polynomial hash modulo 2**64 confuses, for n over 10."""
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_texts_that_polynomials_modulo_2_64_confuse(frame):
    s, t = thue_morse(11)
    got = neardup.near_duplicates(frame([s, t, s]), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 0}
    many = [" ".join(x) for x in (s, t)]  # the same as words
    got = neardup.near_duplicates(frame(["x " + many[0], many[1] + " y"]), 5000).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1}
    for near in ("words", "grams"):
        lone = lines.without_repeated_lines(frame([s + "z" * 700, t + "y" * 700, *many]), min_words=1, near=near).collect()
        assert {r.doc_id: r.n_removed for r in lone if r.doc_id < 2} == {0: 0, 1: 0}
    x = lines.Lines(pa.array(many), 1)
    assert x.key[0].tolist() != x.key[1].tolist()


def test_empty_near_duplicates(frame):
    assert rows(neardup.near_duplicates(frame([]))) == []


def near_copies(n, words=60, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_groups_of_near_copies(frame, monkeypatch):
    """Nodes over the leaf's size, and groups in chunks: the same components."""
    monkeypatch.setattr(groups, "GROUP_BYTES", 6000)
    monkeypatch.setattr(groups, "TILE", 7)
    texts = near_copies(60) + near_copies(30, seed=2) + ["alone and quite different from all the others here"]
    df = frame(texts)
    docs = [(i, t) for i, t in enumerate(texts)]
    got = [r[:4] for r in rows(neardup.near_duplicates(df, 2, leaf=8, levels=2))]
    assert sorted(got) == sorted(near_brute(docs, 2, 80))


def test_wide_nodes_tie_only_what_may_be_similar(spark, monkeypatch):
    """Classes that share a few frequent tokens stand in one node at the last level, but not in one candidate group; near copies do."""
    monkeypatch.setattr(neardup, "DEEPER", 0, raising=False)
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**31, (80, neardup.COORDINATES))
    sig[:, ::2] = 7  # half of the coordinates agree: under AGREE
    for i in range(60, 80):
        sig[i] = sig[60]
        sig[i, rng.integers(0, 64, 6)] = rng.integers(0, 2**31, 6)
    classes = spark.createDataFrame([(b"%03d" % i, [int(x) for x in row]) for i, row in enumerate(sig)], "cls binary, sig array<int>").cache()
    with neardup.Scratch(spark) as cut:
        edges = neardup.candidate_edges(classes, 5, 8, 2, cut).collect()
    root = union_find(80, {(int(a), int(b)) for a, b in edges})
    assert len(set(root[60:])) == 1
    assert max(root.count(r) for r in set(root)) == 20


def test_near_forest_holds_every_pair():
    rng = np.random.default_rng(8)
    m = rng.integers(0, 2**31, (6, 64))[rng.integers(0, 6, 150)]
    for i in range(len(m)):
        k = rng.integers(0, 40)
        m[i, rng.permutation(64)[:k]] = rng.integers(0, 2**31, k)
    root = union_find(len(m), list(zip(*neardup.near_forest(m), strict=True)))
    agree = (m[:, None] == m[None]).sum(axis=2)
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(agree >= neardup.AGREE), strict=True))


def test_linker_is_exact():
    rng = random.Random(4)
    base = [sorted(rng.sample(range(400), 40)) for _ in range(4)]
    sets = []
    for _ in range(120):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(400))
        sets.append(sorted(s))
    linker = neardup.Linker(80)
    for s in sorted(sets, key=len):
        linker.add(s)
    ordered = [frozenset(s) for s in sorted(sets, key=len)]
    links = [(i, j) for i in range(120) for j in range(i) if 100 * len(ordered[i] & ordered[j]) >= 80 * len(ordered[i] | ordered[j])]
    want = union_find(120, links)
    same = lambda x: [x.index(v) for v in x]
    assert same(linker.root) == same(want)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(700, i) for i in range(701, 760)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = union_find(800, edges)
    least = {}
    for i in range(800):
        least[root[i]] = min(least.get(root[i], i), i)
    assert got == {i: least[root[i]] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        n = [i + 1]
        for j, y in enumerate(b):
            n.append(min(d[j] + (x != y), d[j + 1] + 1, n[-1] + 1))
        d = n
    return d[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(1500):
        a, b = (bytes(rng.choices(b"abc", k=rng.randint(0, 14))) for _ in range(2))
        assert lines.edit_distance(a, b, 99) == levenshtein(a, b)
        assert (lines.edit_distance(a, b, 3) <= 3) == (levenshtein(a, b) <= 3)
        assert lines.aligned(a, b, 99) >= levenshtein(a, b)
    for _ in range(200):
        a = bytes(rng.choices(b"abcdefgh ", k=rng.randint(60, 300)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 12)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 9)] = bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 9)))
        d = levenshtein(a, bytes(b))
        assert lines.aligned(a, bytes(b), 10**6) >= d and lines.edit_distance(a, bytes(b), 10**6) == d
        assert (lines.edit_distance(a, bytes(b), len(a) // 5) <= len(a) // 5) == (d <= len(a) // 5)


def test_edit_distance_to_many():
    rng = random.Random(1)
    for _ in range(60):
        a = bytes(rng.choices(b"abcd ", k=rng.choice([1, 3, 130, 200, 270])))
        others = [bytes(rng.choices(b"abcd \0", k=rng.randint(1, 200)))]
        for _ in range(rng.randint(0, 5)):
            b = bytearray(a)
            for _ in range(rng.randint(0, 1 + len(a) // 4)):
                i = rng.randrange(len(b) + 1)
                b[i : i + rng.randint(0, 2)] = bytes(rng.choices(b"abcd ", k=rng.randint(0, 2)))
            others.append(bytes(b) or b"a")
        d = np.array([levenshtein(a, b) for b in others])
        most = np.maximum(0, d + np.array([rng.choice([-30, -1, 0, 0, 3]) for _ in others]))
        assert (lines.all_within(a, others, most) == (d <= most)).all()
        for b, m, true in zip(others, most.tolist(), d.tolist(), strict=True):
            assert (lines.edit_distance(a, b, m) <= m) == (true <= m)


def gone_lines(docs, min_words=3, percent=80):
    """(document, line) removed, by comparing all pairs of lines."""
    order = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0))
    occ = []
    for k, (_, t) in enumerate(order):
        for n, line in enumerate((t or "").split("\n")):
            w = bytes(lines._FORM[np.frombuffer(line.encode(), np.uint8)]).split()
            if len(w) >= min_words:
                occ.append((k, n, b" ".join(w)))
    forms = list(dict.fromkeys(f for *_, f in occ))
    sims = lines.Lines(pa.array([f.decode() for f in forms]), 1).sim if forms else np.zeros(0, np.uint64)
    links = [(i, j) for i in range(len(forms)) for j in np.flatnonzero(np.bitwise_count(sims[:i] ^ sims[i]) <= lines.RADIUS).tolist() if levenshtein(forms[i], forms[j]) <= max(len(forms[i]), len(forms[j])) * (100 - percent) // 100]
    root = dict(zip(forms, union_find(len(forms), links), strict=True))
    first = {}
    for k, n, f in occ:
        first.setdefault(root[f], (k, n))
    return order, {(k, n) for k, n, f in occ if first[root[f]] != (k, n)}, len(links)


def test_line_dedup(frame):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeiorst") for _ in range(rng.randint(2, 6)))
    pool = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(30)]
    texts = [None, "", "two words\ntwo words", "All rights reserved.\n" * 3, "x " * 20_000]
    for _ in range(40):
        mine = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        for i, s in enumerate(mine):
            if rng.random() < 0.4:
                w = s.split(" ")
                w[rng.randrange(len(w))] = word()
                mine[i] = " ".join(w) + rng.choice(["", "!", " 7"])
        texts.append("\n".join(mine))
    texts += [(90, "\n".join(pool[:3])), (90, "\n".join(pool[:3])), (None, pool[1])]
    df = frame(texts)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    order, gone, n_links = gone_lines(docs)
    assert n_links > 3
    want = []
    for d, t in docs:
        k = order.index((d, t))
        all_ = t.split("\n") if t else []
        kept = [x for n, x in enumerate(all_) if (k, n) not in gone]
        want.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(rows(lines.without_repeated_lines(df, digest=True)), key=repr) == sorted(want, key=repr)
    out = lines.without_repeated_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert lines.without_repeated_lines(frame([])).count() == 0


def test_pigeonhole_loses_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 150)
    sims = set(base.tolist())
    for x in base.tolist():
        for _ in range(2):
            flip = 0
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                flip |= 1 << int(b)
            y = (x % 2**64) ^ flip
            sims.add(y - 2**64 if y >= 2**63 else y)
    sims = sorted(sims)
    u = np.array(sims, np.int64).view(np.uint64)
    for leaf in (64, 1):
        monkeypatch.setattr(lines, "LEAF", leaf)
        edges = rows(lines.near_simhashes(spark.createDataFrame([(s,) for s in sims], "sim long")))
        at = {s: i for i, s in enumerate(sims)}
        root = union_find(len(sims), [(at[a], at[b]) for a, b in edges])
        for i in range(len(sims)):
            for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= lines.RADIUS).tolist():
                assert root[i] == root[j]


def test_shards_fit(frame, corpus):
    df = frame([*corpus, *[(500, "same row")] * 300])
    limit = 4000
    got = rows(sharding.shard_ids(df, limit))
    assert sorted(((r.doc_id, len((r.text or "").encode())) for r in df.collect()), key=repr) == sorted(((g[0], g[1]) for g in got), key=repr)
    held = {}
    for d, n, shard, _ in got:
        held.setdefault(shard, []).append(n)
    assert all(sum(v) <= limit or len(v) == 1 for v in held.values())
    names = sorted(k for k in held if "." not in k)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # buckets partition the hash space
    assert rows(sharding.shard_ids(frame([]), limit)) == []


def test_shards_of_a_hot_key(frame):
    df = frame([f"text number {i} of a hot key" for i in range(400)]).withColumn("lang", F.lit("en"))
    got = rows(sharding.shard_ids(df, 1000, keys=("lang",)))
    held = {}
    for _, n, shard, _ in got:
        held[shard] = held.get(shard, 0) + n
    assert len(got) == 400 and max(held.values()) <= 1000


def test_nearest(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((1500, 16)).astype("float32")
    vectors[100:160] = vectors[7]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0]), (2003, [float("nan")] * 16), (2004, [None] * 16), (None, vectors[3].tolist()), (7, vectors[7].tolist()), (2050, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    for settings in ({}, {"leaf": 32, "slice_rows": 16, "trees": 4}):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, **settings).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(got) == list(range(0, 1500, 50))
        m = vectors.astype(float)
        norms = np.sqrt((m * m).sum(axis=1))
        hit = 0
        for q, found in got.items():
            cos = m @ m[q] / norms / norms[q]
            cos[q] = -9
            want = np.lexsort((np.arange(1500), -np.round(cos, 12)))[:5].tolist()
            assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
            assert all(abs(cos[v] - s) < 1e-12 for _, v, s in found)
            assert sorted(found, key=lambda f: (-f[2], f[1])) == sorted(found)
            hit += len(set(want) & {v for _, v, _ in found})
        assert hit / (5 * len(got)) >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def copied_lines(rng, n):
    """Texts of a line each, most of them a few words or letters away from an earlier one."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(n)]
    for s in texts[:n]:
        w = s.split(" ")
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
        i = rng.randrange(len(s))
        texts.append(s[:i] + "Q" + s[i + 1 :])
    return texts


def test_lines_are_linked_by_edit_similarity_alone(frame):
    texts = copied_lines(random.Random(12), 60)
    forms = [t.lower() for t in texts]
    links = [(i, j) for i in range(len(forms)) for j in range(i) if levenshtein(forms[i], forms[j]) <= max(len(forms[i]), len(forms[j])) * 20 // 100]
    assert len(links) > 100
    root = union_find(len(forms), links)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    want = {i for i, r in enumerate(root) if least[r] != i}
    removed = lambda **kw: {r.doc_id for r in lines.without_repeated_lines(frame(texts), **kw).collect() if r.n_removed}
    got = removed(near="grams")
    assert got <= want and len(got) >= 0.97 * len(want)
    assert len(removed()) < 0.8 * len(want)  # SimHash of words: the default of the function, not of query and pipeline


def test_op7_links_by_edit_similarity(spark, tmp_path):
    from loomspark.llm.queries import QUERIES

    texts = copied_lines(random.Random(13), 40)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r.n_removed for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()) >= 76


def test_op7_collapses_lines_of_one_word(spark, tmp_path):
    from corpus_pipeline import line_dedup
    from loomspark.llm.queries import QUERIES

    texts = ["没有空格的一行文字\nfirst text of its own", "没有空格的一行文字\nanother one, unlike it", "Share\nnothing in common here\n\n", "share!\n--\n--\nquite different words\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    assert {r.doc_id: r.text for r in line_dedup(spark, docs, str(tmp_path)).collect()} == {0: texts[0], 1: "another one, unlike it", 2: texts[2], 3: "--\n--\nquite different words\n\n"}


def recall_and_share(spark, vectors, **settings):
    """Recall of the 5 nearest of every 50th vector, and the share of all rows that a query scores."""
    n = len(vectors)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(vectors.astype(np.float32)))})).repartition(8)
    found = ann.nearest(df, F.col("vec_id") % 50 == 0, **settings).toArrow()
    m = vectors.astype(np.float32).astype(float)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    cos = m[::50] @ m.T
    cos[np.arange(len(cos)), np.arange(0, n, 50)] = -2
    want = {(q * 50, v) for q, row in enumerate(np.argpartition(-cos, 5, axis=1)[:, :5].tolist()) for v in row}
    got = set(zip(found["query_id"].to_pylist(), found["vec_id"].to_pylist(), strict=True))
    forest, opened = ann.fitted(df, n, **settings)
    held = np.bincount(forest.leaves(m).ravel(), minlength=forest.n_leaves)
    rows = np.mean([held[forest.route(q, opened)].sum() for q in m[::500]])
    return len(want & got) / len(want), rows / n


def test_forest_narrows_the_search_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.standard_normal((1000, 32)), 50, axis=0) + 0.25 * rng.standard_normal((50_000, 32))
    recall, share = recall_and_share(spark, rng.permutation(vectors))
    assert recall >= 0.9 and share <= 0.1, (recall, share)


def test_forest_keeps_its_recall_on_isotropic_vectors(spark):
    recall, share = recall_and_share(spark, np.random.default_rng(6).standard_normal((4000, 64)))
    assert recall >= 0.9, (recall, share)


def test_cosines_of_extreme_vectors(spark):
    data = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e300, 0.0]), (3, [-1e-310, 0.0])]
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.lit(True)).collect()}
    assert abs(got[0, 1] - 1) < 1e-12 and abs(got[0, 2] - 0.5**0.5) < 1e-12 and got[2, 3] == -1.0


@pytest.mark.parametrize("words", [1 << 18, 4])
def test_bitmap_of_wanted_documents_loses_none(spark, monkeypatch, words):
    """Also where the bitmap is full; null ids among the documents and an empty set of ids do no harm."""
    monkeypatch.setattr(neardup, "WORDS_OF_BITS", words)
    docs = spark.sql("select id - 50 as doc_id, 't' as text from range(3000) union all select null, 'n'")
    ids = docs.where("doc_id % 7 = 0").select("doc_id")
    found = neardup._perhaps_wanted(docs, ids)
    assert found.columns == docs.columns
    assert ids.join(found, "doc_id", "left_anti").count() == 0
    assert neardup._perhaps_wanted(docs, ids.limit(0)).count() == 0
    if words > 4:
        assert found.count() < 1.1 * ids.count()
