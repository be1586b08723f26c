"""Operators on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import ask, communities as cm, graph as gr, messages as ms, persona as ps, retrieval as rt
from loomspark.sources import exports as ex
from loomspark.streaming import changelog as cl


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reject_and_scope(spark):
    df = spark.createDataFrame([(1, "a", "agent", None), (2, " ", "x", True), (3, "b", None, None), (4, "c", "x", False)], "id int, text string, origin string, eligible boolean")
    assert rows(df.where(ms.corpus_predicate()).select("id")) == [(3,)]
    e = spark.createDataFrame([("a", 5), ("b", 9)], "k string, t long")
    assert rows(ms.in_scope(e, e.limit(0), "k", "t")) == [] and rows(ms.in_scope(e, None, "k", "t", since=6)) == [("b", 9)]
    assert ms.purge_victims(e, None, "k", "t", None, None).count() == 0
    assert rows(ms.purge_victims(e, None, "k", "t", None, 5, e.where("k = 'b'"))) == []


def test_sessions_break_at_exactly_three_hours(spark):
    h = 3 * ms.HOUR_MS
    df = spark.createDataFrame([("a", 1, 1000), ("a", 2, 1000 + h - 1), ("a", 3, 1000 + h - 1 + h), ("b", 4, 0), ("b", 5, 9 * h)], "k string, id int, t long")
    got = {r.id: r.session for r in ms.with_sessions(df, "k", "t", "id").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}  # an unknown time never breaks


def test_upsert_is_idempotent(spark):
    schema = "channel string, external string, content_text string, is_self boolean, sent_at long"
    new = spark.createDataFrame([("c", "1", "hello", None, 5)], schema)
    none = spark.createDataFrame([], schema + ", revision int")
    table, changed = ms.upsert_messages(none, new, ["channel", "external"], ["sent_at"])
    assert changed.count() == 1 and table.first().revision == 1
    again, changed = ms.upsert_messages(table, new, ["channel", "external"], ["sent_at"])
    assert changed.count() == 0 and rows(again) == rows(table) and again.first().is_self is None
    edit = spark.createDataFrame([("c", "1", "hello!", True, 3)], schema)
    last, changed = ms.upsert_messages(again, edit, ["channel", "external"], ["sent_at"])
    r = last.first()
    assert changed.count() == 1 and (r.revision, r.content_text, r.is_self, r.sent_at) == (2, "hello!", True, 5)


def test_fold_takes_the_first_row_in_input_order(spark):
    df = spark.createDataFrame([(2, "ADA", 10, "Person"), (1, " Ada ", 99, "Unknown"), (3, "ada", 5, "Person"), (4, "https://x.y", 1, "T"), (5, "a", 1, "T")], "o int, n string, t long, k string")
    assert rows(ms.fold_entities(df, F.col("n"), "o", "t", "k")) == [("ada", "Ada", "Unknown", 99, 3, 99)]


def test_long_descriptions_are_cut_by_tokens(spark):
    df = spark.createDataFrame([("k", i, f"text number {i} " + "x" * 60) for i in range(20)], "k string, i int, t string")
    r = ms.description(df, "k", ["i"], "t").first()
    assert r.n_texts == 20 and r.description.count("- ") == 10


def test_fusion_and_duplicates(spark):
    lists = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "y")], "list string, rank int, id string").withColumn("q", F.lit(0))
    got = {r.id: (round(r.score, 6), r.n_lists) for r in rt.rrf(lists, ["q"], "id").collect()}
    assert got == {"x": (round(1 / 61, 6), 1), "y": (round(1 / 62 + 1 / 61, 6), 2)}
    items = spark.createDataFrame([(0, 1, "a", "fact", "same  text"), (0, 2, "b", "fact", "same text"), (0, 3, "c", "chunk", "same text"), (0, 4, "d", "fact", " "), (0, 5, "e", "fact", " ")], "q int, rank int, id string, kind string, text string")
    kept = {r.id: r.merged_ids for r in rt.collapse_duplicates(items, ["q"], "id", "text", "kind").collect()}
    assert kept == {"a": ["b"], "c": [], "d": [], "e": []}
    assert rt.confidence(spark.createDataFrame([("chunk", None)], "kind string, confidence double")).first()[0] == 0.4


def test_rerank_falls_back(spark):
    df = spark.createDataFrame([(1, "bb"), (2, "a"), (3, "ccc")], "rank int, text string")
    assert [r.text for r in rt.rerank(df, lambda ts: [len(t) for t in ts]).collect()] == ["ccc", "bb", "a"]

    def broken(texts):
        raise OSError("no model")

    assert [r.rank for r in rt.rerank(df, broken).collect()] == [1, 2, 3] == [r.rank for r in rt.rerank(df).collect()]


def test_bm25_prefers_rare_tokens(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the the dog"), (3, "the bird")], "d int, t string").withColumn("w", F.split("t", " "))
    index = rt.postings(docs, "d", F.col("w"))
    q = spark.createDataFrame([(0, "the"), (0, "dog")], "q int, token string")
    hits = rt.bm25(index, q, "d", "q").orderBy(F.desc("score")).collect()
    assert hits[0].d == 2 and len(hits) == 3
    assert rows(rt.bm25(index, q, "d", "q", every_token=True).select("d")) == [(2,)]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "a long, b long, weight double")


CLIQUES = [(a, b, 1) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1), (14, 20, 0.1)]


def test_walk_and_paths(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 5, 1), (5, 4, 1)])
    adj = gr.adjacency(e, "a", "b")
    ones = adj.groupBy("node").agg(F.count("*").cast("double").alias("importance"))
    seeds = spark.createDataFrame([(1, 1.0)], "node long, score double")
    got = {r.node: (round(r.score, 4), r.hop) for r in gr.walk(adj, seeds, ones, radius=3).collect()}
    assert got == {1: (1.0, 0), 2: (0.6, 1), 5: (0.6, 1), 3: (0.36, 2), 4: (0.36, 2)}
    assert {r.node for r in gr.hop(adj, 2, {1: 0.9, 2: 1.0}, ones).collect()} == {3}
    assert [tuple(r.path) for r in gr.shortest_paths(adj, 1, 4).collect()] == [(1, 5, 4)]
    assert gr.shortest_paths(adj, 1, 4, most=1).count() == 0
    assert len(gr.shortest_paths(adj, 1, 3, every=True).collect()) == 1
    assert rows(gr.distances(adj, 1)) == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 1)]


def test_pagerank_sums_to_one(spark):
    r = gr.pagerank(edges(spark, CLIQUES)).collect()
    assert abs(sum(x["rank"] for x in r) - 1) < 1e-6 and len(r) == 15
    assert gr.pagerank(edges(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    e = edges(spark, [(i, i + 1, 1) for i in range(64)] + [(100, 101, 1)])
    got = {r.node: r.component for r in gr.components(e).collect()}
    assert got == {**{i: 0 for i in range(65)}, 100: 100, 101: 100}
    assert gr.largest_component(gr.components(e)).count() == 65


def test_communities_recover_cliques_and_nest(spark):
    e = edges(spark, CLIQUES)
    got = cm.communities(e).collect()
    fine = {r.node: r.cid for r in got if r.level == 0}
    top = max(r.level for r in got)
    assert all(r.cid == r.node // 10 * 10 for r in got if r.level == top)
    for r in got:
        if r.level:
            same = {x.cid for x in got if x.level == r.level and fine[x.node] == fine[r.node]}
            assert len(same) == 1
    assert cm.communities(e.orderBy(F.rand(3))).exceptAll(cm.communities(e)).count() == 0
    q = gr.modularity(e, cm.communities(e).where(F.col("level") == top).select("node", "cid")).first().q
    assert q > 0.6


def test_incremental_communities_are_as_good_as_a_full_run(spark):
    old_edges = edges(spark, [c for c in CLIQUES if c[0] < 15 and c[1] < 15 and c[:2] != (4, 10)])
    delta = edges(spark, [(4, 10, 3.0)])
    new_edges = old_edges.unionByName(delta)

    def top(levels):
        return {r.node: r.cid for r in levels.orderBy("level").collect()}  # the last level stays

    def q(levels):
        return gr.modularity(new_edges, spark.createDataFrame(list(top(levels).items()), "node long, cid long")).first().q

    updated = cm.update_communities(cm.communities(old_edges), new_edges, delta)
    assert top(updated).keys() == top(cm.communities(new_edges)).keys()
    assert q(updated) >= q(cm.communities(new_edges)) - 0.01


def test_identity_events(spark):
    old = spark.createDataFrame([(0, "A", n) for n in range(6)] + [(0, "B", n) for n in range(10, 16)] + [(0, "C", 30), (0, "C", 31)], "level int, identity string, node int")
    new = spark.createDataFrame([(0, 1, n) for n in range(7)] + [(0, 2, n) for n in range(10, 13)] + [(0, 3, n) for n in range(13, 16)] + [(0, 4, 50)], "level int, cid int, node int")
    got = {r.cid or r.identity: (r.identity, r.event) for r in cm.reconcile(old, new, "r").collect()}
    assert got["1"] == ("A", "grown") and got["2"] == ("B", "split") and got["3"][1] == "born" and got["4"][1] == "born" and got["C"] == ("C", "died")


def test_policy(spark):
    base = {"dry_run": False, "reply_mode": "auto", "now": 1_704_099_600_000, "scene_failures": [], "agent_allows": True, "confidence": 0.9, "risk": "low", "draft": "ok", "banned": ["bad"], "sent_minute": 0, "sent_hour": 0, "kill_switch": False, "revoked_at": None, "expires_at": None}
    schema = "dry_run boolean, reply_mode string, now long, scene_failures array<string>, agent_allows boolean, confidence double, risk string, draft string, banned array<string>, sent_minute int, sent_hour int, kill_switch boolean, revoked_at long, expires_at long"
    cases = [
        ({}, [], None), ({"dry_run": True, "confidence": 0.5}, [], "dry_run"), ({"dry_run": True, "reply_mode": "yolo"}, [], "dry_run"), ({"reply_mode": "yolo", "kill_switch": True}, [], None),
        ({"draft": "so bad", "sent_minute": 5}, ["no_banned_phrase", "within_rate_limit"], "banned_phrase"), ({"expires_at": 5, "kill_switch": True}, ["kill_switch_inactive", "has_valid_grant"], "kill_switch"),
        ({"now": 1_704_067_200_000, "risk": "high"}, ["within_work_hours", "confidence_and_risk"], "outside_work_hours"), ({"confidence": -1.0}, [], None), ({"confidence": 0.5, "risk": "high"}, ["confidence_and_risk"], "low_confidence"),
        ({"agent_allows": False}, ["agent_allows_auto"], "agent_requires_review"), ({"revoked_at": 9}, ["has_valid_grant"], "grant_missing"),
    ]
    got = ps.policy_failures(spark.createDataFrame([tuple((base | c).values()) for c, *_ in cases], schema)).collect()
    assert [(r.failed, r.reason, r.decision) for r in got] == [(w, why, "drafted" if why else "auto_sent") for _, w, why in cases]
    rules = spark.createDataFrame([(["no_question"],), (["within_length"],), ([],)], "f array<string>")
    assert [r.r for r in rules.select(ps.risk(F.col("f")).alias("r")).collect()] == ["high", "medium", "low"]
    draft = spark.createDataFrame([("我来处理吗？", "group"), ("好的", "direct"), ("x" * 61, "direct")], "d string, k string")
    assert [r.f for r in draft.select(ps.scene_failures(F.col("d"), F.col("k"), F.lit(False)).alias("f")).collect()] == [["is_direct_or_mentioned", "no_question", "no_commitment"], [], ["within_length"]]
    steps = spark.createDataFrame([([("draft", "a"), ("answer", "b"), ("silent", "c")],), ([],)], "s array<struct<verdict:string,reason:string>>")
    assert [tuple(r.g) for r in steps.select(ps.gate(F.col("s")).alias("g")).collect()] == [("silent", ["a", "c"]), ("answer", [])]


def test_evidence_and_scores(spark):
    facets = spark.createDataFrame([("a", ["1"]), ("b", []), ("c", ["9"]), ("d", ["2"])], "facet string, evidence array<string>")
    msgs = spark.createDataFrame([("1", True), ("2", False)], "id string, is_self boolean")
    assert rows(ps.evidence_problems(facets, msgs)) == [("b", "no_evidence"), ("c", "unknown_evidence"), ("d", "not_self")]
    qa = spark.createDataFrame([(1, "The cats run", "a cat runs fast"), (2, "", ""), (3, "x", "")], "k int, t string, a string")
    assert {r.k: round(r.f1, 4) for r in ps.token_f1(qa, "k", "t", "a").collect()} == {1: 0.8, 2: 1.0, 3: 0.0}
    ev = spark.createDataFrame([(1, ["a", "b"], ["b", "c", "a"]), (2, [], ["a"])], "k int, g array<string>, r array<string>")
    assert rows(ps.evidence_recall(ev, "k", "g", "r", 2)) == [(1, 0.5, False)] and rows(ps.evidence_recall(ev, "k", "g", "r")) == [(1, 1.0, True)]


def test_versioned_write(spark):
    cur = spark.createDataFrame([("f", "a")], "k string, value string")
    rev = spark.createDataFrame([("f", "z", 1)], "k string, value string, revision int")
    now, revs = ps.versioned_write(cur, rev, spark.createDataFrame([("f", "b"), ("g", "c")], "k string, value string"), ["k"])
    assert rows(now) == [("f", "b"), ("g", "c")] and rows(revs) == [("f", "a", 2), ("f", "z", 1)]
    assert ps.versioned_write(now, revs, now, ["k"])[1].count() == 2


@pytest.fixture
def export(tmp_path):
    words = lambda i: " ".join(f"word{i}" for _ in range(180))
    t0 = 1_700_000_000_000
    recs = [{"id": f"m{i}", "scope_id": "s", "type": "message", "data": {"openMessageId": f"m{i}", "openConversationId": "c", "sender": ["Ann", "Bob"][i % 2], "content": words(i), "createTime": t0 + i * 60_000}} for i in range(8)]
    recs.append({"id": "m8", "scope_id": "s", "type": "message", "data": {"openMessageId": "m8", "openConversationId": "c", "sender": "Ann", "content": "late", "createTime": t0 + 7 * 60_000 + 3 * 3_600_000, "quotedMessage": {"openMessageId": "m0", "sender": "Ann", "content": "q"}}})
    recs.append({"id": "w1", "scope_id": "", "type": "document_unit", "data": {"text": "# A\n" + "x " * 900 + "\n# B\ny", "docUrl": "https://h/doc7"}})
    recs.append({"id": "e1", "scope_id": "s", "type": "email", "data": {"body": {"id": "e1", "conversationId": "t", "subject": "Hi", "markdownBody": "body", "from": {"name": "Ann"}, "toRecipients": [{"name": "Bob"}, {"email": "c@d"}], "receivedDateTime": "2024-01-01T00:00:00Z"}}})
    recs.append({"id": "mm1", "scope_id": "meet", "type": "minutes", "data": {"unit_kind": "summary", "text": "sum", "started_at": t0}})
    recs.append({"id": "mm2", "scope_id": "meet", "type": "minutes", "data": {"unit_kind": "transcript", "page_index": 0, "lines": [{"speaker": "Ann", "text": "hello"}]}})
    recs.append({"id": "g1", "scope_id": "s", "type": "task", "data": {"result": {"title": "T", "text": "a task to do", "createTime": t0}}})
    (tmp_path / "records.jsonl").write_text("\n".join([json.dumps(r) for r in recs] + ["", "not json", "[1]"]))
    (tmp_path / "scopes.jsonl").write_text(json.dumps({"id": "s", "type": "conversation", "data": {"title": "Team"}}))
    return str(tmp_path)


def test_export_sources(spark, export):
    r = ex.records(spark, export)
    assert r.count() == 14 and ex.scopes(spark, export).first().title == "Team"
    m = ex.messages(r, "Ann")
    assert {x.id: x.session for x in m.collect()} == {**{f"m{i}": 0 for i in range(8)}, "m8": 1}
    slices = ex.message_slices(m)
    got = slices.collect()
    assert 2 < len(got) < 9 and all(s.content.startswith("[") for s in got)
    kinds = {}
    for e in ex.chat_edges(slices, m).collect():
        kinds[e.edge_type] = kinds.get(e.edge_type, 0) + 1
    assert kinds == {"TEMPORAL": len(got) - 2, "REPLY_TO": 1}
    w = ex.wiki(r).collect()
    assert len(w) >= 3 and all(x.timestamp == 0 and x.id.startswith("wiki:doc7:") for x in w)
    mail = ex.mail(r).collect()
    assert [(x.id, x.timestamp) for x in mail] == [("mail:e1", 1_704_067_200_000)] and "To: Bob, c@d" in mail[0].content
    assert sorted(x.id for x in ex.minutes(r).collect()) == ["minutes:meet:0", "minutes:meet:summary"]
    g = ex.generic(r, "task").first()
    assert g.content.startswith("T · 17") and "a task to do" in g.content
    assert ex.union_sources(ex.wiki(r), ex.mail(r), ex.generic(r, "task")).count() == len(w) + 2


def test_window_offsets(spark):
    units = spark.createDataFrame([("c", i, f"u{i}", "x" * n) for i, n in enumerate([500, 700, 1, 1500, 0])], "k string, o int, u string, t string")
    got = ex.fixed_windows(units, "k", "o", "u", "t").collect()
    text, at = "", {}
    for i, n in enumerate([500, 700, 1, 1500]):
        at[f"u{i}"] = len(text)
        text += "x" * n
    want = set()
    w = 0
    while True:
        s, e = w * 1000, min(w * 1000 + 1200, len(text))
        for u, f in at.items():
            n = [500, 700, 1, 1500][int(u[1])]
            if max(s, f) < min(e, f + n):
                want.add((w, u, max(s, f) - f, min(e, f + n) - f))
        if e == len(text):
            break
        w += 1
    assert {(r.window, r.u, r.unit_start, r.unit_end) for r in got} == want


def test_streams(spark, tmp_path):
    schema = "id int, k string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).write.parquet(str(tmp_path / "in" / "0"))
    src = lambda: cl.deduplicated(cl.source(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema), ["id"])
    go = lambda: cl.run_available(src(), str(tmp_path / "ck"), cl.batch_sink(str(tmp_path / "out")))
    go()
    go()  # a restart without news adds nothing
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.parquet(str(tmp_path / "in" / "1"))
    go()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id")) == [(1,), (2,), (3,)]


def test_cursors_and_consumers(spark):
    old = spark.createDataFrame([("s", 100, 50)], "scope string, watermark long, floor long")
    ev = spark.createDataFrame([("s", 40, 90, True), ("s", 10, 500, False), ("t", 5, 9, True)], "scope string, window_start long, window_end long, ok boolean")
    assert rows(cl.merge_cursors(old, ev)) == [("s", 100, 40), ("t", 9, 5)]
    assert cl.next_window(1_000_000, 2_000_000) == (880_000, 2_300_000)
    assert cl.consumer_order({"b": ["a"], "a": [], "c": ["b", "a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="a -> b -> a"):
        cl.consumer_order({"a": ["b"], "b": ["a"]})
    calls = []

    def fail():
        raise RuntimeError("no")

    done = cl.run_cycle({"a": [], "b": ["a"], "c": [], "d": ["b"]}, {"a": lambda: calls.append("a"), "b": fail, "c": lambda: calls.append("c"), "d": lambda: calls.append("d")})
    assert calls == ["a", "c"] and done["d"] == "skipped" and done["b"].startswith("failed")
    assert cl.bisected(0, 240_000, lambda a, b: (b - a) // 1000, 100) == [(0, 60_000), (60_000, 120_000), (120_000, 180_000), (180_000, 240_000)]
    control = spark.createDataFrame([(10**9, None, 1, 0, 0), (10**9, 10**9 - 7_200_000, 600, 0, 0), (10**9, 10**9 - 7_200_000, 600, 1, 10**9 - 60_000), (10**9, 10**9 - 7_200_000, 3, 0, 0)], "now long, last_build long, lag int, failures int, last_failure long")
    assert [r.decision for r in cl.build_decision(control).collect()] == ["first", "lag", "wait", "idle"]


def test_steps_resume(spark, tmp_path):
    ran = []
    steps = [("load", lambda: ran.append("load")), ("build", lambda: ran.append("build"))]
    s = ask.Steps(spark, str(tmp_path / "steps"), "f1")
    assert s.run(steps[:1]) == ["load"] and s.run(steps) == ["build"] and s.run(steps) == []
    assert ask.Steps(spark, str(tmp_path / "steps"), "f2").run(steps) == ["load", "build"]
    with pytest.raises(KeyError, match="known: document"):
        ask.strategy(ask.CHUNKERS, "nope")


def test_incremental_similarity_equals_full(spark):
    import numpy as np

    m = np.random.default_rng(5).standard_normal((60, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    full = rt.similar_pairs(v, 0.5, 60, block_rows=16)
    new = v.where("vec_id % 7 = 0").select("vec_id")
    got = ask.incremental_similarity(v, new, 0.5, 60)
    assert rows(got.select("a", "b")) == rows(full.where("a % 7 = 0 or b % 7 = 0").select("a", "b"))
    s = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    assert rows(full.select("a", "b")) == sorted(((i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5), key=repr)


def test_outbox_and_retention(spark, tmp_path):
    log = spark.range(20).select((F.col("id") + 1).alias("seq"))
    c = spark.createDataFrame([("a", 12, True, 100, 1000, False), ("b", 5, True, -9999, 1000, False), ("c", 3, False, 100, 1000, False)], "consumer_id string, acked_seq long, required boolean, heartbeat_at long, stale_after_ms long, needs_full_rebuild boolean")
    assert cl.prunable_changes(log, c, 100, keep=10).count() == 10
    assert cl.prunable_changes(log, c, 100, keep=5).count() == 12
    ex.append_new(spark, str(tmp_path / "raw"), spark.createDataFrame([(1, "a"), (1, "a")], "id int, h string"), ["id", "h"])
    ex.append_new(spark, str(tmp_path / "raw"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, h string"), ["id", "h"])
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_common_letters_of_short_names_still_block(spark):
    from itertools import combinations

    names = {i: "王" + chr(0x4E00 + 7 * i) for i in range(260)}  # the shared letter is all that two of them have in common
    e = spark.createDataFrame([(i, n, 1, []) for i, n in names.items()], "entity long, name string, mentions long, messages array<long>")
    none = spark.createDataFrame([], "a long, b long")
    got = {(r.a, r.b) for r in gr.disambiguation_candidates(e, none).collect()}
    want = {(a, b) for a, b in combinations(names, 2) if len(set(names[a]) & set(names[b])) >= 0.3 * len(set(names[a]) | set(names[b]))}
    assert want <= got and len(want) == 260 * 259 // 2
