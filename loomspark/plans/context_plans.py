"""Queries around entities, facts and communities, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx, graph as gr, messages as ms, persona as ps, retrieval as rt
from .tables import events, millis, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def parts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_size").alias("mentions"))


@query("resolve_names", """
WITH q AS (SELECT unnest(['12', 'red widget', 'ring', 'nothing like it']) AS query),
h AS (SELECT query, p_partkey AS entity, p_size, CASE WHEN CAST(p_partkey AS VARCHAR) = query THEN 0 WHEN lower(p_name) = query THEN 1 ELSE 2 END AS prio FROM part, q WHERE CAST(p_partkey AS VARCHAR) = query OR contains(lower(p_name), query))
SELECT query, entity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY prio, p_size DESC, entity) AS r FROM h) WHERE r = 1""")
def resolve_names(spark, d):
    return cx.resolve_names(parts(spark, d), spark.createDataFrame([("12",), ("red widget",), ("ring",), ("nothing like it",)], "query string"))


@query("level_columns", """
SELECT c_custkey AS node, c_nationkey AS "community_L0", CASE WHEN c_custkey % 5 <> 0 THEN n_regionkey END AS "community_L1", CAST(NULL AS INTEGER) AS "community_L2" FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def level_columns(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    long = c.select(F.col("c_custkey").alias("node"), F.lit(0).alias("level"), F.col("c_nationkey").alias("cid")).unionByName(c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("node"), F.lit(1).alias("level"), F.col("n_regionkey").alias("cid")))
    return cx.level_columns(long, [0, 1, 2])


@query("batch_hydration", """
WITH r AS (SELECT DISTINCT 'part' AS node_type, l_partkey AS node FROM lineitem UNION SELECT DISTINCT 'supplier', l_suppkey FROM lineitem UNION SELECT 'ghost', 1)
SELECT r.node_type, node, coalesce(p_name, s_name) AS label FROM r LEFT JOIN part ON r.node_type = 'part' AND p_partkey = node LEFT JOIN supplier ON r.node_type = 'supplier' AND s_suppkey = node WHERE coalesce(p_name, s_name) IS NOT NULL""")
def batch_hydration(spark, d):
    li = read(spark, d, "lineitem")
    refs = li.select(F.lit("part").alias("node_type"), F.col("l_partkey").alias("node")).unionByName(li.select(F.lit("supplier").alias("node_type"), F.col("l_suppkey").alias("node"))).unionByName(spark.createDataFrame([("ghost", 1)], "node_type string, node long"))
    return cx.hydrate(refs, {"part": read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label")), "supplier": read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label"))})


@query("stance_facts", """
SELECT DISTINCT o_orderkey AS fact, l_partkey AS entity, p_name AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus IN ('F', 'P') AND c_mktsegment = 'BUILDING'""")
def stance_facts(spark, d):
    facts = read(spark, d, "orders").select(F.col("o_orderkey").alias("fact"), F.col("o_custkey").alias("chunk"), F.when(F.col("o_orderstatus") == "F", "DECISION").when(F.col("o_orderstatus") == "P", "OPINION").otherwise("STATUS").alias("fact_type"))
    units = read(spark, d, "customer").select(F.col("c_custkey").alias("unit"), "c_mktsegment")
    links = units.select(F.col("unit").alias("chunk"), "unit")
    about = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_partkey").alias("entity")).distinct()
    return cx.stance_facts(facts, units, links, about, parts(spark, d), F.col("c_mktsegment") == "BUILDING")


@query("fact_conversations", "SELECT event_id AS fact, json_extract_string(props, '$.k') AS conversation FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') IS NOT NULL")
def fact_conversations(spark, d):
    e = read(spark, d, "events")
    return cx.fact_conversations(e.where("event_type = 'click'").select(F.col("event_id").alias("fact"), F.col("event_id").alias("chunk")), e.select(F.col("event_id").alias("chunk"), F.col("props").alias("metadata")), "$.k")


@query("scoped_facts", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def scoped_facts(spark, d):
    members = read(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return cx.in_conversation(read(spark, d, "orders"), members, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderkey", "o_custkey")


@query("entity_card", """
SELECT 7 AS entity, (SELECT p_name FROM part WHERE p_partkey = 7) AS name, (SELECT count(*) FROM lineitem WHERE l_partkey = 7) AS degree,
(SELECT string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY ms DESC, l_orderkey DESC) FROM (SELECT l_orderkey, epoch_ms(l_shipdate) AS ms FROM lineitem WHERE l_partkey = 7 ORDER BY ms DESC, l_orderkey LIMIT 5)) AS facts""")
def entity_card(spark, d):
    li = read(spark, d, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") + 0).alias("target"), F.col("l_quantity").alias("weight")).where("target = 7").withColumn("source", F.col("source") + 1_000_000)
    facts = li.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("fact"), millis("l_shipdate").alias("ms"))
    none = spark.createDataFrame([], "a long, b long")
    card = cx.entity_card(7, parts(spark, d), edges, facts, none, spark.createDataFrame([], "node long, level int, cid long"))
    return card.select(F.col("entity").cast("int").alias("entity"), "name", "degree", F.array_join(F.transform("facts", lambda f: f.cast("string")), ",").alias("facts"))


@query("fact_context", """
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), n AS (SELECT a.event_id AS fact, b.event_id AS id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ms, b.event_id) AS position FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.ms - b.ms) < 3600000 WHERE a.event_type = 'error')
SELECT fact, id, CAST(position AS INTEGER) AS position FROM n WHERE position <= 7 AND fact <> id""")
def fact_context(spark, d):
    e = events(spark, d)
    m = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation"), "ms")
    return cx.fact_context(e.where("event_type = 'error'").select(F.col("event_id").alias("fact"), F.col("event_id").alias("message")), m, 3_600_000)


@query("community_context", """
WITH h AS (SELECT c_nationkey AS cid, count(*) AS matches FROM customer WHERE c_custkey < 400 GROUP BY 1), t AS (SELECT 0 AS level, h.cid, matches, greatest(1, length(n_name) // 4) AS tokens FROM h JOIN nation ON n_nationkey = h.cid),
r AS (SELECT *, sum(tokens) OVER (ORDER BY matches DESC, level, cid ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT level, cid, matches, CAST(used AS BIGINT) AS used FROM r WHERE used <= 15""")
def community_context(spark, d):
    seeds = read(spark, d, "customer").where("c_custkey < 400").select(F.col("c_custkey").alias("entity"))
    placed = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.lit(0).alias("level"), F.col("c_nationkey").alias("cid"))
    reports = read(spark, d, "nation").select(F.lit(0).alias("level"), F.col("n_nationkey").alias("cid"), F.col("n_name").alias("text"), F.lit(1.0).alias("rating"))
    return cx.community_context(seeds, placed, reports, 100).select("level", "cid", "matches", "used")


@query("text_units", """
WITH s AS (SELECT p_partkey AS entity, p_size * 1.0 AS score FROM part WHERE p_partkey < 40), m AS (SELECT DISTINCT l_partkey AS entity, l_orderkey % 1000 AS chunk FROM lineitem), h AS (SELECT chunk, count(*) AS hits, max(score) AS score FROM s JOIN m USING (entity) GROUP BY 1),
r AS (SELECT chunk, hits, sum(greatest(1, length(text) // 4)) OVER (ORDER BY hits DESC, score DESC, chunk ROWS UNBOUNDED PRECEDING) AS used FROM h JOIN documents ON doc_id = chunk) SELECT chunk, hits, CAST(used AS BIGINT) AS used FROM r WHERE used <= 8000""")
def text_units(spark, d):
    seeds = read(spark, d, "part").where("p_partkey < 40").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("score"))
    mentions = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), (F.col("l_orderkey") % 1000).alias("chunk")).distinct()
    none = spark.createDataFrame([], "entity long, fact long")
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "text")
    return cx.text_units(seeds, mentions, spark.createDataFrame([], "fact long, chunk long"), none, chunks).select("chunk", "hits", "used")


@query("community_browse", "SELECT c_nationkey AS cid, count(*) AS member_count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def community_browse(spark, d):
    r = read(spark, d, "customer").groupBy(F.lit(0).alias("level"), F.col("c_nationkey").alias("cid")).agg(F.count("*").alias("member_count"))
    return cx.browse(r, 0, 5).select("cid", "member_count")


@query("activity_joins", """
SELECT l_orderkey AS attempt, l_linenumber AS line, o_orderstatus AS state, c_name AS trigger_text FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def activity_joins(spark, d):
    attempts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("line"))
    o = read(spark, d, "orders")
    drafts = o.select(F.col("o_orderkey").alias("draft"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("run"))
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("trigger"))
    messages = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return cx.activities(attempts, drafts, runs, messages).select("attempt", "line", "state", "trigger_text")


@query("interlocutors", """
SELECT DISTINCT 's' || s_nationkey AS peer, l_orderkey AS message FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION SELECT 'c' || c_nationkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def interlocutors(spark, d):
    li = read(spark, d, "lineitem")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    own = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("chunks")).join(o, "l_orderkey", "left").select(F.col("l_orderkey").alias("message"), F.col("o_custkey").alias("conversation"), "chunks")
    private = read(spark, d, "customer").select(F.col("c_custkey").alias("conversation"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("peer"))
    group = read(spark, d, "supplier").select(F.col("s_suppkey").alias("chunk"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("peer"))
    return cx.interlocutors(private, group, own)


@query("structural_map", "SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS n_chunks, min(l_orderkey) AS first_chunk FROM lineitem GROUP BY 1")
def structural_map(spark, d):
    m = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("chunk"))
    got = cx.structural_maps(m, m.withColumnRenamed("chunk", "fact"))["chunks_of_entity"]
    return got.select("entity", F.size("chunks").cast("long").alias("n_chunks"), F.element_at("chunks", 1).alias("first_chunk"))


@query("latest_prior_run", "SELECT o_orderstatus AS level, max(o_custkey) AS seq FROM orders WHERE o_custkey < 900 GROUP BY 1")
def latest_prior_run(spark, d):
    ledger = read(spark, d, "orders").select(F.col("o_orderstatus").alias("level"), F.col("o_custkey").alias("seq"), F.col("o_custkey").cast("string").alias("run"))
    ledger = ledger.unionByName(spark.createDataFrame([("X", 900, "now")], "level string, seq long, run string"))
    return cx.latest_prior_run(ledger, "now").select("level", F.col("run").cast("long").alias("seq"))


@query("membership_churn", """
WITH m AS (SELECT o_custkey AS community, list_distinct(list(o_orderpriority) FILTER (o_orderdate < TIMESTAMP '1998-01-01')) AS was, list_distinct(list(o_orderpriority) FILTER (o_orderdate >= TIMESTAMP '1998-01-01')) AS now FROM orders GROUP BY 1)
SELECT community, CAST(len(list_filter(now, lambda x: NOT list_contains(was, x))) AS BIGINT) AS added, CAST(len(list_filter(was, lambda x: NOT list_contains(now, x))) AS BIGINT) AS removed, CAST(len(list_intersect(was, now)) AS BIGINT) AS kept FROM m WHERE was IS NOT NULL AND now IS NOT NULL""")
def membership_churn(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("community"), "o_orderpriority", "o_orderdate")
    side = lambda c: o.where(c).groupBy("community").agg(F.collect_set("o_orderpriority").alias("members"))
    return cx.churned_members(side("o_orderdate < '1998-01-01'"), side("o_orderdate >= '1998-01-01'"))


@query("upsert_accumulators", """
WITH o AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last_seen, count(*) AS n FROM events WHERE event_id < 5000 GROUP BY 1), n AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last_seen, count(*) AS n FROM events WHERE event_id >= 5000 GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, greatest(o.last_seen, n.last_seen) AS last_seen, coalesce(o.n, 0) + coalesce(n.n, 0) AS mention_count FROM o FULL JOIN n ON n.user_id = o.user_id""")
def upsert_accumulators(spark, d):
    e = events(spark, d)
    side = lambda c: e.where(c).groupBy("user_id").agg(F.max("ms").alias("last_seen"), F.count("*").alias("mention_count")).withColumn("description", F.lit(None).cast("string"))
    return ms.merge_counts(side("event_id < 5000"), side("event_id >= 5000"), "user_id").select("user_id", "last_seen", "mention_count")


@query("walk_mermaid")
def walk_mermaid(spark, d):
    n = read(spark, d, "nation").where("n_nationkey < 4")
    nodes = n.select(F.col("n_nationkey").alias("node"), F.lit("entity").alias("node_type"), F.col("n_name").alias("label"))
    edges = n.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") + 1) % 4).alias("target"), F.lit("ABOUT").alias("edge_type"))
    return cx.mermaid(nodes, edges)


@query("ranked_expansion", """
SELECT l_orderkey AS item, round(max(p_size / 50.0 * 0.0001 * CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 1 END * (1 - l_discount)), 9) AS score FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey < 20 GROUP BY 1""")
def ranked_expansion(spark, d):
    e = read(spark, d, "part").where("p_partkey < 20").select(F.col("p_partkey").alias("entity"), (F.col("p_size") / 50.0).alias("sim"), F.col("p_type").alias("entity_type"))
    facts = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("fact"), F.lit("STATUS").alias("fact_type"), (1 - F.col("l_discount")).alias("confidence"))
    mentions = facts.select("entity", F.col("fact").alias("chunk")).limit(0)
    out = rt.expand(e, mentions, facts, spark.createDataFrame([], "entity long, rank double"), ["ECONOMY"], ["DECISION"])
    return out.where("kind = 'fact'").select("item", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- small filters and orders


@query("trivial_messages", """
SELECT role, count(*) AS n, count(*) FILTER (NOT (length(t) <= 3 OR regexp_full_match(t, '(?i)(ok|thx|thanks|666)'))) AS kept FROM (SELECT role, trim(coalesce(text, '')) AS t FROM conversations) GROUP BY role""")
def trivial_messages(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(ms.worth_extracting(F.col("text"))).alias("kept"))


@query("active_entities", "SELECT p_partkey AS entity, p_name AS name FROM part WHERE p_size % 10 <> 0 AND contains(lower(p_name), 'ring')")
def active_entities(spark, d):
    status = F.when(F.col("p_size") % 10 == 0, "quarantined").otherwise("active")
    rows = read(spark, d, "part").withColumn("quality_status", status)
    return ms.active(rows).where(F.lower("p_name").contains("ring")).select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))


@query("recent_in_order", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8)""")
def recent_in_order(spark, d):
    return ms.recent_in_order(events(spark, d), "user_id", "ms", "event_id", 8).select("user_id", "event_id", "position")


@query("ordered_dedup", """
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)""")
def ordered_dedup(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(ms.first_seen(F.split("text", " ")), " ").alias("words"))


def typed_edges(spark, d):
    e = read(spark, d, "lineitem").select(F.lit("fact").alias("source_type"), F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linenumber") % 2 == 0, "entity").otherwise("chunk").alias("target_type"), F.col("l_partkey").alias("target_id"), F.when(F.col("l_linenumber") % 2 == 0, "ABOUT").otherwise("FROM").alias("edge_type"), F.when(F.col("l_returnflag") == "R", "broken {").otherwise(F.format_string('{"weight": %d}', F.col("l_quantity").cast("int"))).alias("properties"))
    return e


@query("scan_edges", """
SELECT l_orderkey AS source_id, l_partkey AS target_id, CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS weight FROM lineitem WHERE l_linenumber % 2 = 0""")
def scan_edges(spark, d):
    return gr.scan_edges(typed_edges(spark, d), ["ABOUT", "SIMILAR"], target_type="entity").select("source_id", "target_id", F.col("properties")["weight"].alias("weight"))


@query("scan_edges_of_frontier", """
SELECT DISTINCT l_orderkey AS source_id, l_partkey AS target_id, l_linenumber % 2 = 0 AS about FROM lineitem
WHERE l_linenumber % 2 = 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def scan_edges_of_frontier(spark, d):
    nodes = read(spark, d, "part").where("p_size = 7").select(F.lit("entity").alias("type"), F.col("p_partkey").alias("id")).unionByName(read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("fact").alias("type"), F.col("o_orderkey").alias("id")))
    return gr.scan_edges_of(typed_edges(spark, d), nodes).select("source_id", "target_id", (F.col("edge_type") == "ABOUT").alias("about")).distinct()


@query("send_policy", """
WITH p AS (SELECT o_orderkey AS id, o_orderstatus = 'P' AS dry, CASE WHEN o_orderpriority = '5-LOW' THEN 'yolo' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'draft' ELSE 'auto' END AS mode, o_totalprice FROM orders)
SELECT id, CASE WHEN dry THEN 'dry_run' WHEN mode = 'yolo' THEN NULL WHEN mode = 'draft' THEN 'mode_not_auto' WHEN o_totalprice < 1000 THEN 'agent_requires_review' WHEN o_totalprice < 100000 THEN 'low_confidence' WHEN id % 7 = 0 THEN 'banned_phrase' WHEN id % 11 = 0 THEN 'kill_switch' END AS reason,
CASE WHEN dry THEN 'drafted' WHEN mode = 'yolo' THEN 'auto_sent' WHEN mode = 'draft' OR o_totalprice < 100000 OR id % 7 = 0 OR id % 11 = 0 THEN 'drafted' ELSE 'auto_sent' END AS decision FROM p""")
def send_policy(spark, d):
    none = F.lit(None).cast("long")
    o = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("dry_run"), F.when(F.col("o_orderpriority") == "5-LOW", "yolo").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "draft").otherwise("auto").alias("reply_mode"),
        F.lit(1_704_099_600_000).alias("now"), F.array().cast("array<string>").alias("scene_failures"), (F.col("o_totalprice") >= 1000).alias("agent_allows"), F.when(F.col("o_totalprice") < 100_000, 0.5).otherwise(-1.0).alias("confidence"),
        F.lit("low").alias("risk"), F.when(F.col("o_orderkey") % 7 == 0, "so bad").otherwise("fine").alias("draft"), F.array(F.lit("bad")).alias("banned"), F.lit(0).alias("sent_minute"), F.lit(0).alias("sent_hour"), (F.col("o_orderkey") % 11 == 0).alias("kill_switch"), none.alias("revoked_at"), none.alias("expires_at"),
    )
    return ps.policy_failures(o).select("id", "reason", "decision")
