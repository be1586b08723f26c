"""Queries of chunking, packing, communities, profiles and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import python as py, text as tx
from ..operators import ask, checkpoints, communities as cm, graph as gr, leiden as ld, packing as pk, persona as ps, retrieval as rt
from ..sources import exports as ex
from ..streaming import changelog as cl
from .graph_plans import part_edges
from .tables import events, read, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("fixed_windows", """
WITH n AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, w AS window, w * 1000 AS start, least(w * 1000 + 1200, n) AS "end" FROM (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 1200) / 1000)) AS BIGINT) + 1)) AS w FROM n)""")
def fixed_windows(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("at"), F.col("doc_id").alias("unit"))
    return ex.fixed_windows(docs, "doc_id", "at", "unit", "text").select("doc_id", "window", "start", F.col("end").cast("long").alias("end"))


@query("chunk_documents")
def chunk_documents(spark, d):
    return py.explode_chunks(read(spark, d, "documents"), "text", "doc_id")


@query("pack_batches", """
WITH RECURSIVE t AS (SELECT source, doc_id, CAST(ceil(n_chars / 1.5) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE ceil(n_chars / 1.5) <= 6800),
r(source, doc_id, i, batch, used) AS (SELECT source, doc_id, i, 0::BIGINT, tokens FROM t WHERE i = 1 UNION ALL SELECT t.source, t.doc_id, t.i, CASE WHEN r.used + t.tokens > 6800 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used + t.tokens > 6800 THEN t.tokens ELSE r.used + t.tokens END FROM r JOIN t ON t.source = r.source AND t.i = r.i + 1)
SELECT source, doc_id, batch FROM r""")
def pack_batches(spark, d):
    rows = read(spark, d, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 1.5).alias("tokens"))
    return pk.pack_batches(rows, "source", "doc_id", "tokens", 6800).select("source", "doc_id", "batch")


@query("message_slices")
def message_slices(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(":")).alias("header"))
    return py.slice_sessions(rows, ["conv_id"], ["turn"], "text", "header", "turn")


@query("register_vector", """
WITH own AS (SELECT conv_id, text FROM conversations WHERE role = 'assistant' AND text <> ''), o AS (SELECT conv_id, avg(length(text)) AS other FROM conversations WHERE role <> 'assistant' GROUP BY 1)
SELECT own.conv_id, round(avg(length(text)), 6) AS avg_msg_length, round(stddev_pop(length(text)), 6) AS msg_length_variance, round(avg(CASE WHEN regexp_matches(text, '[?？]') THEN 1.0 ELSE 0.0 END), 6) AS question_ratio,
round(avg(CASE WHEN regexp_matches(text, '[!！]') THEN 1.0 ELSE 0.0 END), 6) AS exclamation_ratio, round(avg(length(text)) / any_value(other), 6) AS turn_length_ratio FROM own LEFT JOIN o ON o.conv_id = own.conv_id GROUP BY own.conv_id""")
def register_vector(spark, d):
    v = ps.register_vector(read(spark, d, "conversations").withColumn("ms", F.col("turn") + 1), "conv_id", "ms", "turn", "text", F.col("role") == "assistant")
    return v.select("conv_id", *(F.round(c, 6).alias(c) for c in ("avg_msg_length", "msg_length_variance", "question_ratio", "exclamation_ratio", "turn_length_ratio")))


@query("register_vector_full")
def register_vector_full(spark, d):
    return ps.register_vector(read(spark, d, "conversations").withColumn("ms", F.col("turn") + 1), "conv_id", "ms", "turn", "text", F.col("role") == "assistant")


@query("topic_features", """
SELECT l_partkey AS topic, count(DISTINCT l_suppkey) AS evidence_count, max(l_orderkey) AS opinion_recency, round(avg(100 - CAST(round(l_discount * 100) AS BIGINT)), 6) AS opinion_strength FROM lineitem GROUP BY 1""")
def topic_features(spark, d):
    f = read(spark, d, "lineitem").select(F.col("l_partkey").alias("topic"), F.col("l_orderkey").alias("fact"), F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("ms"), (100 - F.round(F.col("l_discount") * 100).cast("long")).alias("confidence"))
    return ps.topic_features(f, "topic").select("topic", "evidence_count", "opinion_recency", F.round("opinion_strength", 6).alias("opinion_strength"))


@query("facet_fold")
def facet_fold(spark, d):
    rows = events(spark, d).select("user_id", F.lit("mean_value").alias("facet"), F.col("value").cast("string").alias("value"), F.lit(0.5).alias("confidence"), F.array(F.col("event_id").cast("string")).alias("evidence"), F.lit("stat").alias("source"), "event_id")
    return py.fold_facets(rows, ["user_id", "facet"], "event_id").select("user_id", F.round(F.col("value").cast("double"), 4).alias("value"), F.size("evidence").alias("n_evidence"), "revision")


@query("scene_rules", """
SELECT conv_id, turn, (role = 'user') AS is_group, regexp_matches(text, '[?？]') AS asks, length(trim(text)) > 60 OR trim(text) = '' AS too_long FROM conversations""")
def scene_rules(spark, d):
    f = ps.scene_failures(F.col("text"), F.when(F.col("role") == "user", "group").otherwise("direct"), F.lit(False))
    has = lambda n: F.array_contains("f", n)
    return read(spark, d, "conversations").withColumn("f", f).select("conv_id", "turn", has("is_direct_or_mentioned").alias("is_group"), has("no_question").alias("asks"), has("within_length").alias("too_long"))


@query("leiden_levels")
def leiden_levels(spark, d):
    return cm.communities(part_edges(spark, d))


def top_quality(edges, levels):
    """Modularity of the communities: the last level."""
    top = levels.agg(F.max("level")).first()[0]
    return gr.modularity(edges, levels.where(F.col("level") == top).select("node", "cid")).first()["q"]


@query("leiden_quality")
def leiden_quality(spark, d):
    edges = checkpoints.cut(part_edges(spark, d))
    levels = checkpoints.cut(cm.communities(edges))
    return spark.createDataFrame([(round(top_quality(edges, levels), 4),)], "q double")


@query("leiden_upkeep")
def leiden_upkeep(spark, d):
    """Communities of parts bought together before the last order date, brought up to date with that day's orders: their modularity beside
    that of a full run, and the nodes of communities that were worked on."""
    dates = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    bought = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(dates, "l_orderkey").distinct()
    last = bought.agg(F.max("o_orderdate")).first()[0]

    def pairs(rows):
        return gr.co_participation(rows, "l_orderkey", "l_partkey").select("a", "b", F.col("shared").cast("double").alias("weight"))

    new = checkpoints.cut(pairs(bought))
    old = checkpoints.cut(ld.leiden(pairs(bought.where(F.col("o_orderdate") < last))))
    levels, worked = ld.updated(old, new, pairs(bought.where(F.col("o_orderdate") == last)).select("a", "b"))
    levels = checkpoints.cut(levels)
    row = (round(top_quality(new, levels), 4), round(top_quality(new, checkpoints.cut(ld.leiden(new))), 4), worked.count(), levels.select("node").distinct().count())
    return spark.createDataFrame([row], "q double, q_full double, n_worked long, n_nodes long")


@query("identity_lineage", """
WITH RECURSIVE x AS (SELECT c_nationkey AS n, o_custkey AS node, o_orderdate AS day FROM orders JOIN customer ON c_custkey = o_custkey),
o AS MATERIALIZED (SELECT DISTINCT 'n' || n AS identity, node FROM x WHERE day < '1998-01-01'), w AS MATERIALIZED (SELECT DISTINCT CAST(n * 10 AS VARCHAR) AS cid, node FROM x WHERE day >= '1997-01-01'),
so AS (SELECT identity, count(*) AS n_old FROM o GROUP BY 1), sn AS (SELECT cid, count(*) AS n_new FROM w GROUP BY 1),
p AS MATERIALIZED (SELECT cid, identity, common, n_new, n_old FROM (SELECT cid, identity, count(*) AS common FROM w JOIN o USING (node) GROUP BY 1, 2) JOIN so USING (identity) JOIN sn USING (cid)),
g AS MATERIALIZED (SELECT cid, identity, row_number() OVER (ORDER BY common / (n_new + n_old - common) DESC, common DESC, identity, cid) AS i FROM p
WHERE common >= 2 AND (common / (n_new + n_old - common) >= 0.3 OR common / least(n_new, n_old) >= 0.5)),
r(i, new, old) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL
SELECT g.i, CASE WHEN free THEN list_append(new, cid) ELSE new END, CASE WHEN free THEN list_append(old, identity) ELSE old END
FROM (SELECT g.i, g.cid, g.identity, r.new, r.old, NOT list_contains(r.new, g.cid) AND NOT list_contains(r.old, g.identity) AS free FROM r JOIN g ON g.i = r.i + 1) g),
f AS MATERIALIZED (SELECT unnest(new) AS cid, unnest(old) AS identity FROM (SELECT new, old FROM r ORDER BY i DESC LIMIT 1)),
s AS (SELECT cid, count(*) AS n_sources FROM p WHERE common >= 2 AND 2 * common >= n_old GROUP BY 1), t AS (SELECT identity, count(*) AS n_targets FROM p WHERE common >= 2 AND 2 * common >= n_new GROUP BY 1),
h AS (SELECT cid, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('run-2:0:' || cid)) AS h FROM sn)
SELECT 0 AS level, sn.cid, coalesce(f.identity, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32]) AS identity,
CASE WHEN f.identity IS NULL THEN 'born' WHEN n_sources > 1 THEN 'merged' WHEN n_targets > 1 THEN 'split' WHEN n_new > n_old THEN 'grown' WHEN n_new < n_old THEN 'shrunk' ELSE 'continued' END AS event
FROM sn JOIN h ON h.cid = sn.cid LEFT JOIN f ON f.cid = sn.cid LEFT JOIN so ON so.identity = f.identity LEFT JOIN s ON s.cid = sn.cid LEFT JOIN t ON t.identity = f.identity
UNION ALL SELECT 0, NULL, so.identity, 'died' FROM so ANTI JOIN f ON f.identity = so.identity""")
def identity_lineage(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    old = o.where("o_orderdate < '1998-01-01'").select(F.lit(0).alias("level"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("identity"), F.col("o_custkey").alias("node")).distinct()
    new = o.where("o_orderdate >= '1997-01-01'").select(F.lit(0).alias("level"), (F.col("c_nationkey") * 10).alias("cid"), F.col("o_custkey").alias("node")).distinct()
    return cm.reconcile(old, new, "run-2")


@query("incremental_similarity")
def incremental_similarity(spark, d):
    e = read(spark, d, "embeddings")
    return ask.incremental_similarity(e, e.where("vec_id % 10 = 0"), 0.4, 10).withColumn("score", F.round("score", 6))


@query("embed_distinct")
def embed_distinct(spark, d):
    return ex.embed_distinct(read(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


STREAM_SQL = """
WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS was FROM e),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR ms - was >= 10800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM g)
SELECT user_id, session_n, count(*) AS n_sessions FROM (SELECT user_id, session, count(*) AS session_n FROM s GROUP BY 1, 2) GROUP BY 1, 2"""


def _streamed(spark, d, name, build):
    """The final table of a streaming query over ``events``: all that has arrived, and one sentinel that closes every window."""
    base = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    e = events(spark, d).select("event_id", "user_id", "event_type", F.timestamp_millis("ms").alias("at"))
    e.repartition(4, "user_id").sortWithinPartitions("at").write.parquet(f"{base}/in/events")
    late = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("sentinel").alias("event_type"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("at"))
    stream = cl.source(spark, f"{base}/in/*", e.schema, 100)
    cl.run_available(build(stream), f"{base}/checkpoint", cl.batch_sink(f"{base}/out"))
    late.write.parquet(f"{base}/in/sentinel")
    cl.run_available(build(stream), f"{base}/checkpoint", cl.batch_sink(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").drop("batch")


def _shared(spark):
    checkpoints.cut(spark.range(1))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@query("stream_sessions", STREAM_SQL)
def stream_sessions(spark, d):
    out = _streamed(spark, d, "sessions", lambda s: cl.sessions(s, "user_id", "at")).where("user_id >= 0")
    return out.groupBy("user_id", F.col("n").alias("session_n")).agg(F.count("*").alias("n_sessions"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return _streamed(spark, d, "dedup", lambda s: cl.deduplicated(s, ["user_id", "event_type"])).where("user_id >= 0").select("user_id", "event_type")


@query("stream_tumbling", "SELECT event_type, epoch_us(ts) // 21600000000 * 21600 AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = _streamed(spark, d, "tumbling", lambda s: cl.tumbling(s, "at", "6 hours", "event_type", late="1 hour")).where("event_type <> 'sentinel'")
    return out.select("event_type", F.unix_seconds("window_start").alias("window_start"), "n")


QUESTION = "what happened to the small ring with that of the onen"
INTENT = ask.Intent(["small ring"], ["ECONOMY"], ["STATUS"])
#: The graph of each state of the tables, with its ranks and indexes: made by the first question of a session.
GRAPHS: dict[tuple, ask.Graph] = {}


CHUNKS: dict[tuple, ask.Graph] = {}


def chunk_graph(spark, d):
    """The documents of :func:`knowledge` alone, for questions that read nothing else; their index is the same one."""
    docs = read(spark, d, "documents")
    key = (spark.sparkContext.applicationId, *state(docs))
    if key not in CHUNKS:
        CHUNKS[key] = ask.Graph(docs.select(F.col("doc_id").alias("chunk"), "text"), *[None] * 4)
    return CHUNKS[key]


def knowledge(spark, d):
    """Documents as chunks, parts as entities, orders as facts about their parts; a document mentions the part of its number."""
    docs, li = read(spark, d, "documents"), read(spark, d, "lineitem")
    key = (spark.sparkContext.applicationId, *state(docs), *state(li))
    if key not in GRAPHS:
        part = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_size").alias("mentions"))
        facts = li.groupBy(F.col("l_orderkey").alias("fact")).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.min("l_partkey").alias("chunk"))
        facts = checkpoints.cut(facts).select("fact", F.format_string("order %d about the shipment", "fact").alias("text"), F.lit("STATUS").alias("fact_type"), "confidence", "chunk")
        mentions = docs.select(F.col("doc_id").alias("chunk")).join(part.select("entity"), F.col("chunk") == F.col("entity")).select("entity", "chunk")
        about = li.select(F.col("l_orderkey").alias("fact"), F.col("l_partkey").alias("entity")).distinct()
        counts = checkpoints.cut(about.groupBy("entity").agg(F.count("*").alias("n")))
        ranks = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("entity", (F.col("n") / F.col("all")).alias("rank"))  # one row
        chunks = chunk_graph(spark, d)
        GRAPHS[key] = ask.Graph(chunks.chunks, part, facts, mentions, about, ranks, chunks.indexes)
    return GRAPHS[key]


@query("ask_question")
def ask_question(spark, d):
    found = ask.ask(spark, knowledge(spark, d), QUESTION, INTENT)
    return found["items"].select("item", "kind", F.round("score", 6).alias("score"), "rank")


@query("ask_expansion", """
WITH f AS MATERIALIZED (SELECT l_orderkey AS fact, max(1 - l_discount) AS confidence FROM lineitem GROUP BY 1),
ab AS MATERIALIZED (SELECT DISTINCT l_orderkey AS fact, l_partkey AS entity FROM lineitem),
r AS (SELECT entity, count(*) / (SELECT count(*) FROM ab) AS rank FROM ab GROUP BY 1),
exact AS (SELECT p_partkey AS entity FROM part WHERE lower(p_name) = 'small ring'),
m AS MATERIALIZED (SELECT entity FROM (SELECT entity FROM exact ORDER BY entity LIMIT 3) UNION SELECT p_partkey FROM part WHERE contains(lower(p_name), 'small ring') AND NOT EXISTS (SELECT * FROM exact)),
s AS (SELECT m.entity, coalesce(rank, 0.0001) * CASE WHEN p_type = 'ECONOMY' THEN 2.0 ELSE 1.0 END AS base FROM m JOIN part ON p_partkey = m.entity LEFT JOIN r ON r.entity = m.entity),
g AS (SELECT 'chunk' AS kind, CAST(doc_id AS VARCHAR) AS item, max(base) AS score FROM s JOIN documents ON doc_id = s.entity GROUP BY 2
UNION ALL SELECT 'fact', CAST(ab.fact AS VARCHAR), max(base * confidence * 2.0) FROM s JOIN ab ON ab.entity = s.entity JOIN f ON f.fact = ab.fact GROUP BY 2)
SELECT kind, item, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, item) AS rank FROM g) WHERE rank <= 20""")
def ask_expansion(spark, d):
    """The lists around matched entities."""
    g = knowledge(spark, d)
    return ask.expansion_lists(g, ask.matched_entities(g, INTENT), INTENT).select("kind", "item", "rank")


@query("ask_chunks", """
WITH t AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_+#.-]+'), lambda x: lower(x)) AS words FROM documents),
p AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(words) AS length, unnest(words) AS token FROM t) GROUP BY 1, 2),
st AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM (SELECT DISTINCT doc_id, length FROM p)),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
q AS (SELECT DISTINCT unnest(string_split('what happened to the small ring with that of the onen', ' ')) AS token),
sc AS (SELECT doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM q JOIN p USING (token) JOIN df USING (token), st GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS item, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 20""")
def ask_chunks(spark, d):
    """The lexical list of a question over whole documents, words and Han text alike (R2)."""
    return ask.lexical_list(chunk_graph(spark, d), QUESTION, "chunk", 20).select("item", "rank")


@query("global_points", """
WITH t AS (SELECT conv_id, turn, trim(text) AS text, length(text) % 101 AS score FROM conversations WHERE trim(text) <> '')
SELECT conv_id AS batch, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, text, CAST(score AS INTEGER) AS score FROM t QUALIFY score > 0""")
def global_points(spark, d):
    """Each conversation's turns as a rater's answer: the points in a fenced block or amid prose."""
    turns = read(spark, d, "conversations").select("conv_id", F.struct("turn", "text", (F.length("text") % 101).alias("score")).alias("p"))
    points = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["text"].alias("text"), p["score"].alias("score")))  # a conversation's turns
    made = turns.groupBy(F.col("conv_id").alias("batch")).agg(F.to_json(F.struct(points.alias("points"))).alias("json"))
    fenced = F.concat(F.lit("```json\n"), "json", F.lit("\n```"))
    answers = made.select("batch", F.when(F.col("batch") % 2 == 0, fenced).otherwise(F.concat(F.lit("so: "), "json", F.lit(" ok"))).alias("answer"))
    return rt.global_points(answers)
