"""The stored inverted index against scores computed from the texts, and against rebuilds."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.operators import textindex
from loomspark.operators.retrieval import top_k
from loomspark.operators.textindex import TextIndex, recall


def words(rng, n):
    return " ".join("w" + str(int(rng.expovariate(0.08))) for _ in range(n))


def brute(docs, queries):
    """{(query, doc): (score, tokens)} of live documents by the definition."""
    bags = {d: Counter(t.split()) for d, t in docs.items() if t and t.split()}
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in queries.items():
        for d, b in bags.items():
            hit = [t for t in set(text.split()) if t in b]
            if hit:
                length = sum(b.values())
                score = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in hit)
                out[q, d] = (round(score, 6), len(hit))
    return out


def best(scores, queries, k, by):
    out = {}
    for q in queries:
        rows = [(-v[by], d) for (a, d), v in scores.items() if a == q]
        out[q] = [d for _, d in sorted(rows)[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    docs = {i: words(rng, rng.choice([0, 1, 5, 30, 200])) for i in range(300)}
    docs[300], docs[301] = docs[5], docs[5]
    return docs, {q: words(rng, 6) + " w0 unknown" for q in range(12)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def tokens():
    return F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")


def asked(spark, queries):
    return frame(spark, queries).select(F.col("doc_id").alias("query_id"), F.explode(tokens()).alias("token"))


def found(index, spark, queries, k, by="score", **settings):
    hits = index.search(asked(spark, queries), k, by=(by,), **settings)
    rows = top_k(hits, "query_id", [F.desc(by), F.col("doc")], k).collect()
    out = {q: [] for q in queries}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r.doc)
    return out


@pytest.mark.parametrize("settings", [{}, {"prune_from": 1}])
def test_search_equals_scores_of_all_documents(spark, data, settings, monkeypatch):
    docs, queries = data
    monkeypatch.setattr(textindex, "TOGETHER", 5)  # several blocks of queries
    index = TextIndex.build(frame(spark, {**docs, 999: None}), "doc_id", tokens(), shards=7)
    scores = brute(docs, queries)
    for by, place in (("score", 0), ("n_tokens", 1)):
        assert found(index, spark, queries, 5, by, **settings) == best(scores, queries, 5, place)
    hits = {(r.query_id, r.doc): (r.score, r.n_tokens) for r in index.search(asked(spark, queries), 1000, **settings).collect()}
    assert hits.keys() == scores.keys() and all(hits[p][1] == s[1] and hits[p][0] == pytest.approx(s[0], abs=2e-6) for p, s in scores.items())


def test_upserts_deletions_and_merge_equal_a_rebuild(spark, data):
    docs, queries = data
    rng = random.Random(8)
    live = {i: t for i, t in docs.items() if i < 200}
    index = TextIndex.build(frame(spark, live), "doc_id", tokens(), shards=4)
    changes = [({i: words(rng, 20) for i in range(150, 260)}, [3, 4, 5, 777]), ({i: words(rng, 3) for i in (0, 3, 155)}, [156, 257])]
    for new, gone in changes:
        index.upsert(frame(spark, new), "doc_id", tokens())
        live |= new
        index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id long"), "doc_id")
        live = {i: t for i, t in live.items() if i not in gone}
        assert found(index, spark, queries, 8) == best(brute(live, queries), queries, 8, 0)
        assert found(index, spark, queries, 8, prune_from=1) == best(brute(live, queries), queries, 8, 0)
    again = TextIndex.build(frame(spark, live), "doc_id", tokens(), shards=3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(index.terms()) == rows(again.terms()) and rows(index.documents()) == rows(again.documents()) and index.stats() == again.stats()
    assert len(index.log()) == 5
    index.merge()
    assert len(index.log()) == 1
    assert rows(index.terms()) == rows(again.terms()) and index.stats() == again.stats()
    assert found(index, spark, queries, 8) == best(brute(live, queries), queries, 8, 0)


def test_scope_bounds_results_not_statistics(spark, data):
    docs, queries = data
    index = TextIndex.build(frame(spark, docs), "doc_id", tokens())
    inside = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    scores = {p: s for p, s in brute(docs, queries).items() if p[1] % 3 == 0 and p[1] < 300}
    assert found(index, spark, queries, 5, scope=inside) == best(scores, queries, 5, 0)
    assert not any(found(index, spark, queries, 5, scope=inside.limit(0)).values())


def test_unfinished_commits_are_not_read(spark, data):
    docs, queries = data
    index = TextIndex.build(frame(spark, docs), "doc_id", tokens())
    before = found(index, spark, queries, 5)
    frame(spark, {1: "w0"}).write.parquet(f"{index.folder}/seg=1/docs")  # died before its row in the log
    assert found(index, spark, queries, 5) == before
    index.upsert(frame(spark, {1: "w1 w1"}), "doc_id", tokens())
    assert found(index, spark, queries, 5) == best(brute({**docs, 1: "w1 w1"}, queries), queries, 5, 0)


def test_empty_index(spark):
    index = TextIndex.build(frame(spark, {}), "doc_id", tokens())
    assert index.search(asked(spark, {1: "a b"}), 5).count() == 0
    index.upsert(frame(spark, {4: "a"}), "doc_id", tokens())
    assert [r.doc for r in index.search(asked(spark, {1: "a b"}), 5).collect()] == [4]


def test_recall_falls_back_to_relaxed_tokens(spark):
    """Han text: strict are unigrams and bigrams, relaxed the unigrams alone."""
    docs = {1: "项目预算会议", 2: "预项算目", 3: "budget review", 4: "周五 budget"}
    index = TextIndex.build(frame(spark, docs), "doc_id", tx.tokenize("text"))
    tiers = frame(spark, {1: "预算", 2: "目项", 3: "budget", 4: "nothing 预算"}).select(F.col("doc_id").alias("query_id"), tx.query_tiers("text").alias("tiers"))
    got = sorted((r.query_id, r.doc, r.relaxed) for r in recall(index, tiers, 10).collect())
    assert got == [(1, 1, False), (2, 1, True), (2, 2, True), (3, 3, False), (3, 4, False)]
    scope = spark.createDataFrame([(4,)], "doc_id long")
    assert [(r.query_id, r.doc) for r in recall(index, tiers, 10, scope=scope).collect()] == [(3, 4)]
    assert recall(index, tiers, 10, scope=scope.limit(0)).count() == 0


def shuffled(spark):
    """Bytes that all stages until now have written for others."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_do_not_move_when_documents_are_indexed(spark):
    """Only counts by token are shuffled by a build, and only ids by an upsert, however many documents there are."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("word"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("string")) for i in range(30))).alias("text"))
    before = shuffled(spark)
    index = TextIndex.build(rows, "doc_id", tokens())
    assert index.stats()[0] == 20_000 and index.terms().count() == 50
    built = shuffled(spark)
    assert built - before < 800_000  # the ids, to see that none is there twice; the postings are some 460 000
    index.upsert(rows.where("doc_id % 4 = 0").withColumn("text", F.lit("new")), "doc_id", tokens())
    assert shuffled(spark) - built < 800_000
    assert {r.token: r.df for r in index.terms().collect()}["new"] == 5000


def test_an_id_in_several_rows_counts_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a"), (3, ""), (3, None), (None, "a")], "doc_id long, text string")
    index = TextIndex.build(rows, "doc_id", tokens())
    assert sorted((r.token, r.df) for r in index.terms().collect()) == [("a", 2), ("b", 1), ("c", 1)] and index.stats() == (2, 2.5)


def test_tokens_of_plain_texts_equal_those_of_runs(spark):
    texts = ["Ab_c c++ x.y, É a1", "\u0130x \u212a9 K", "项目 Mix项a", "", None, "tab\tNEW\nline #tag -"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(tx.tokenize("text")).collect()]
    assert got == [["ab_c", "c++", "x.y", "a1"], ["x", "9", "k"], ["项", "项目", "目", "mix", "项", "a"], [], [], ["tab", "new", "line", "#tag", "-"]]
