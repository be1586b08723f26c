"""Queries on the message stream (``events``) and the relational tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators import messages as ms
from .tables import events, millis, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY0 = 1_704_067_200_000  # 2024-01-01
OFFSET = 8 * 3_600_000


def mine():
    return F.col("event_type") == "purchase"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


EV = "e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events)"


@query("corpus_predicate", """
SELECT source, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE text IS NOT NULL AND trim(text) <> '' AND lang IS DISTINCT FROM 'de' AND quality IS DISTINCT FROM 0 GROUP BY source""")
def corpus_predicate(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("source", "text", F.when(F.col("lang") == "de", "agent").otherwise("human").alias("origin"), (F.col("quality") == 1).alias("eligible"))
    return rows.where(ms.corpus_predicate()).groupBy("source").agg(F.count("*").alias("n"))


@query("reject_reasons", """
SELECT CASE WHEN source IS NULL THEN 'identity' WHEN lang = 'de' THEN 'self' WHEN source = 'src3' THEN 'bot' WHEN trim(text) = '' THEN 'empty' WHEN quality = 0 THEN 'disabled' ELSE 'accepted' END AS reason, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def reject_reasons(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    reason = ms.reject_reason([("identity", F.col("source").isNull()), ("self", F.col("lang") == "de"), ("bot", F.col("source") == "src3"), ("empty", F.trim("text") == ""), ("disabled", F.col("quality") == 0)])
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("scope_filter", f"""
WITH {EV} SELECT user_id, count(*) AS n FROM e WHERE ms >= {DAY0 + 86_400_000} AND ms <= {DAY0 + 10 * 86_400_000}
AND user_id IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 200) GROUP BY user_id""")
def scope_filter(spark, d):
    e = events(spark, d)
    scopes = e.where("event_type = 'signup' and value > 200")
    return ms.in_scope(e, scopes, "user_id", "ms", DAY0 + 86_400_000, DAY0 + 10 * 86_400_000).groupBy("user_id").agg(F.count("*").alias("n"))


@query("attention_routing", f"""
WITH {EV}, s AS (SELECT c_custkey AS user_id, c_acctbal > 3000 AS enabled, {DAY0} + c_custkey % 20 * 86400000 AS enabled_at FROM customer WHERE c_custkey % 3 <> 0)
SELECT CASE WHEN s.user_id IS NULL THEN 'not_in_scope' WHEN NOT enabled THEN 'scope_disabled' WHEN ms < enabled_at THEN 'before_enabled_at' ELSE 'routed' END AS routing, event_type, count(*) AS n
FROM e LEFT JOIN s ON s.user_id = e.user_id GROUP BY 1, 2""")
def attention_routing(spark, d):
    k = F.col("c_custkey")
    scopes = read(spark, d, "customer").where(k % 3 != 0).select(k.alias("user_id"), (F.col("c_acctbal") > 3000).alias("enabled"), (F.lit(DAY0) + k % 20 * 86_400_000).alias("enabled_at"))
    return ms.route(events(spark, d), scopes, "user_id", "ms").groupBy("routing", "event_type").agg(F.count("*").alias("n"))


@query("payload_filter", "SELECT event_id, event_type, value FROM events WHERE value >= 50 AND value < 90 AND event_type IN ('click', 'view') AND user_id = 8")
def payload_filter(spark, d):
    return ms.payload_filter(read(spark, d, "events"), {"value_gte": 50, "value_lt": 90, "event_type": ["click", "view"], "user_id": 8}).select("event_id", "event_type", "value")


@query("fact_explorer_page", """
WITH f AS (SELECT p_partkey, p_name, p_type, p_retailprice FROM part WHERE contains(p_name, 'red') AND p_retailprice >= 950 AND p_type IN ('ECONOMY', 'STANDARD'))
SELECT p_partkey, p_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10""")
def fact_explorer_page(spark, d):
    rows = read(spark, d, "part").where(ms.like_escaped(F.col("p_name"), "red") & (F.col("p_retailprice") >= 950) & F.col("p_type").isin("ECONOMY", "STANDARD"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(20).crossJoin(F.broadcast(total)).select("p_partkey", "p_name", "total")


@query("changelog_since", "SELECT event_id AS seq, event_type AS domain, user_id FROM events WHERE event_id > 500 AND ((user_id & 4) <> 0 OR user_id IS NULL) AND event_type = 'click' ORDER BY event_id LIMIT 200")
def changelog_since(spark, d):
    rows = read(spark, d, "events").where((F.col("event_id") > 500) & (F.col("user_id").bitwiseAND(4).isNull() | (F.col("user_id").bitwiseAND(4) != 0)) & (F.col("event_type") == "click"))
    return rows.orderBy("event_id").limit(200).select(F.col("event_id").alias("seq"), F.col("event_type").alias("domain"), "user_id")


@query("min_watermark", """
WITH c AS (SELECT user_id, max(event_id) AS acked, bool_or(value > 250) AS rebuilding FROM events GROUP BY user_id)
SELECT coalesce(min(acked) FILTER (NOT rebuilding AND user_id % 2 = 0), 0) AS retainable FROM c""")
def min_watermark(spark, d):
    c = read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("acked"), F.bool_or(F.col("value") > 250).alias("rebuilding"))
    return c.agg(F.coalesce(F.min(F.when(~F.col("rebuilding") & (F.col("user_id") % 2 == 0), F.col("acked"))), F.lit(0)).alias("retainable"))


@query("head_by_domain", "SELECT event_type AS domain, max(event_id) AS head FROM events GROUP BY event_type")
def head_by_domain(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("domain")).agg(F.max("event_id").alias("head"))


@query("name_lookup", """
SELECT p_partkey, p_name, p_size FROM (SELECT *, CASE WHEN CAST(p_partkey AS VARCHAR) = '12' THEN 0 WHEN p_name = 'red' THEN 1 WHEN contains(p_name, 'ring') THEN 2 END AS prio FROM part) WHERE prio IS NOT NULL ORDER BY prio, p_size DESC, p_partkey LIMIT 5""")
def name_lookup(spark, d):
    prio = F.when(F.col("p_partkey").cast("string") == "12", 0).when(F.col("p_name") == "red", 1).when(F.col("p_name").contains("ring"), 2)
    return read(spark, d, "part").withColumn("prio", prio).where("prio is not null").orderBy("prio", F.desc("p_size"), "p_partkey").limit(5).select("p_partkey", "p_name", "p_size")


@query("missing_bodies", "SELECT page_id, url FROM pages WHERE lower(split_part(split_part(url, '.', 2), '/', 1)) IN ('ththth', 'ththre') OR html IS NULL")
def missing_bodies(spark, d):
    host = F.lower(F.split_part(F.split_part("url", F.lit("."), F.lit(2)), F.lit("/"), F.lit(1)))
    return read(spark, d, "pages").where(host.isin("ththth", "ththre") | F.col("html").isNull()).orderBy(F.desc_nulls_last("page_id")).select("page_id", "url")


@query("purge_victims", f"""
WITH {EV}, a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), w AS (SELECT DISTINCT user_id FROM events WHERE value > 200)
SELECT event_type, count(*) AS n FROM e WHERE user_id NOT IN (SELECT user_id FROM a) OR ms < {DAY0 + 86_400_000} OR (ms > {DAY0 + 20 * 86_400_000} AND user_id NOT IN (SELECT user_id FROM w)) GROUP BY event_type""")
def purge_victims(spark, d):
    e = events(spark, d)
    return ms.purge_victims(e, e.where("event_type = 'signup'"), "user_id", "ms", DAY0 + 86_400_000, DAY0 + 20 * 86_400_000, e.where("value > 200")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("directed_facts_for_day", """
SELECT o_orderkey, c.c_name AS requester, n.n_name AS place FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-06-01' AND c.c_nationkey IN (1, 2, 3) AND c.c_custkey IS NOT NULL AND c.c_custkey NOT IN (1, 2)""")
def directed_facts_for_day(spark, d):
    o = read(spark, d, "orders").where((F.col("o_orderdate") >= "1997-05-01") & (F.col("o_orderdate") < "1997-06-01"))
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return rows.where(F.col("c_nationkey").isin(1, 2, 3) & F.col("c_custkey").isNotNull() & ~F.col("c_custkey").isin(1, 2)).select("o_orderkey", F.col("c_name").alias("requester"), F.col("n_name").alias("place"))


@query("unseen_units", "SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.event_type = 'signup' AND k.value > 150)")
def unseen_units(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return e.join(e.where("event_type = 'signup' and value > 150").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


@query("stale_probes", f"""
WITH {EV}, l AS (SELECT user_id, max(ms) AS local FROM e WHERE event_id % 7 <> 0 GROUP BY user_id), p AS (SELECT user_id, max(ms) AS probe FROM e GROUP BY user_id)
SELECT p.user_id, probe, local FROM p LEFT JOIN l ON l.user_id = p.user_id WHERE local IS NULL OR probe > local + 60000""")
def stale_probes(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ms")
    both = e.groupBy("user_id").agg(F.max("ms").alias("probe"), F.max(F.when(F.col("event_id") % 7 != 0, F.col("ms"))).alias("local"))  # one pass gives both sides
    return both.where(F.col("local").isNull() | (F.col("probe") > F.col("local") + 60_000)).select("user_id", "probe", "local")


@query("interval_context", f"""
WITH {EV}, n AS (SELECT a.event_id AS l_event_id, b.event_id AS r_event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ms, b.event_id) AS position
FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.ms - b.ms) < 300000 WHERE a.event_type = 'purchase')
SELECT l_event_id, r_event_id, CAST(position AS INTEGER) AS position FROM n WHERE position <= 7""")
def interval_context(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    return ms.interval_neighbours(e.where(mine()), e.drop("event_type"), "user_id", "ms", order="event_id").select("l_event_id", "r_event_id", "position")


@query("latest_per_conversation", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_conversation(spark, d):
    return ms.latest_per(events(spark, d), "user_id", ["ms", "event_id"], ["event_id", "event_type"])


@query("latest_per_channel", f"WITH {EV} SELECT event_type, user_id, max(ms) AS latest FROM e GROUP BY event_type, user_id")
def latest_per_channel(spark, d):
    return events(spark, d).groupBy("event_type", "user_id").agg(F.max("ms").alias("latest"))


@query("group_members", f"""
WITH {EV} SELECT user_id, event_type AS sender, count(*) AS n, arg_max(props, event_id) AS display FROM e WHERE event_type <> 'purchase' GROUP BY user_id, event_type""")
def group_members(spark, d):
    rows = events(spark, d).where(~mine())
    return rows.groupBy("user_id", F.col("event_type").alias("sender")).agg(F.count("*").alias("n"), F.max_by("props", F.struct("ms", "event_id")).alias("display"))


@query("peer_mode", f"""
WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n, max(ms) AS last FROM e WHERE event_type <> 'purchase' GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC, event_type DESC) AS r FROM c) WHERE r = 1""")
def peer_mode(spark, d):
    return ms.mode_by(events(spark, d).where(~mine()), "user_id", "event_type", "ms")


@query("relational_division", """
WITH u AS (SELECT DISTINCT o_orderstatus, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT count(DISTINCT o_orderstatus) AS n_groups FROM u)
SELECT c_nationkey, n_groups FROM (SELECT c_nationkey, count(DISTINCT o_orderstatus) AS n FROM u GROUP BY 1), g WHERE n = n_groups AND n_groups >= 2""")
def relational_division(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", "o_custkey").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return ms.in_every(o, "o_orderstatus", "c_nationkey")


@query("answered_semi_join", f"""
WITH {EV}, r AS (SELECT user_id, max(ms) AS last FROM e WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.event_id FROM e LEFT JOIN r ON r.user_id = e.user_id WHERE e.event_type = 'error' AND (r.last IS NULL OR r.last <= e.ms)""")
def answered_semi_join(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    return ms.still_open(e.where("event_type = 'error'"), e.where(mine()), "user_id", "ms").select("event_id")


@query("latest_inbound_mentioned", f"""
WITH {EV} SELECT user_id, max(event_id) AS event_id FROM e a WHERE ms > {DAY0 + 5 * 86_400_000} AND event_type <> 'purchase'
AND EXISTS (SELECT 1 FROM events m WHERE m.user_id = a.user_id AND m.event_type = 'signup' AND m.value > 100) GROUP BY user_id""")
def latest_inbound_mentioned(spark, d):
    e = events(spark, d)
    rows = e.where(~mine() & (F.col("ms") > DAY0 + 5 * 86_400_000)).join(e.where("event_type = 'signup' and value > 100"), "user_id", "left_semi")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ms", "event_id")).alias("event_id"))


@query("reply_latency", f"""
WITH {EV}, w AS (SELECT user_id, event_id, ms, event_type, (SELECT min(r.ms) FROM e r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND (r.ms, r.event_id) > (e.ms, e.event_id)) AS reply_at FROM e)
SELECT user_id, count(reply_at) AS n, CAST(sum(reply_at - ms) AS BIGINT) AS waited FROM w WHERE event_type <> 'purchase' GROUP BY user_id""")
def reply_latency(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ms", "event_type")
    return ms.next_match(e, "user_id", "ms", "event_id", mine()).groupBy("user_id").agg(F.count("reply_at").alias("n"), F.sum(F.col("reply_at") - F.col("ms")).alias("waited"))


@query("routine_histograms", f"""
WITH {EV}, h AS (SELECT (ms + {OFFSET}) // 3600000 % 24 AS hour FROM e)
SELECT s.hour, count(h.hour) AS n FROM (SELECT unnest(range(0, 24)) AS hour) s LEFT JOIN h ON h.hour = s.hour GROUP BY s.hour""")
def routine_histograms(spark, d):
    counts = events(spark, d).groupBy((F.floor((F.col("ms") + OFFSET) / 3_600_000) % 24).alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(counts, "hour", "left").fillna(0, ["n"])


@query("nearest_rank_percentile", f"""
WITH {EV}, p AS (SELECT *, lag(event_type) OVER w AS was, ms - lag(ms) OVER w AS latency FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
l AS (SELECT user_id, list_sort(list(latency)) AS x FROM p WHERE event_type = 'purchase' AND was <> 'purchase' GROUP BY user_id)
SELECT user_id, CAST(len(x) AS INTEGER) AS n, x[CAST(floor((len(x) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50, x[CAST(floor((len(x) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90 FROM l""")
def nearest_rank_percentile(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ms", "event_type")
    x = ms.previous_latency(e, "user_id", "ms", "event_id", mine()).groupBy("user_id").agg(F.collect_list("latency").alias("x"))
    return x.select("user_id", F.size("x").alias("n"), ms.nearest_rank(F.col("x"), 0.5).alias("p50"), ms.nearest_rank(F.col("x"), 0.9).alias("p90"))


@query("daily_trend_spine", f"""
WITH {EV}, s AS (SELECT {DAY0 - OFFSET} + i * 86400000 AS day FROM (SELECT unnest(range(0, 40)) AS i)),
c AS (SELECT (ms + {OFFSET}) // 86400000 * 86400000 - {OFFSET} AS day, count(*) FILTER (event_type <> 'purchase') AS inbound, count(*) FILTER (event_type = 'purchase') AS outbound, count(*) FILTER (value > 100) AS media FROM e GROUP BY 1)
SELECT s.day, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(media, 0) AS media FROM s LEFT JOIN c ON c.day = s.day""")
def daily_trend_spine(spark, d):
    return ms.day_trends(events(spark, d), "ms", OFFSET, DAY0 - OFFSET, 40, {"inbound": ~mine(), "outbound": mine(), "media": F.col("value") > 100})


@query("trend_summary", f"""
WITH {EV}, s AS (SELECT {DAY0} + i * 86400000 AS day FROM (SELECT unnest(range(0, 40)) AS i)), c AS (SELECT ms // 86400000 * 86400000 AS day, count(*) AS n FROM e GROUP BY 1),
t AS (SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.day = s.day)
SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n) FILTER (n > 0), 6) AS mean_active, (SELECT day FROM t ORDER BY n DESC, day LIMIT 1) AS busiest_day, count(*) FILTER (n = 0) AS empty_days FROM t""")
def trend_summary(spark, d):
    return ms.trend_summary(ms.day_trends(events(spark, d), "ms", 0, DAY0, 40, {"n": F.lit(True)}), "n")


@query("coverage_by_day", f"""
WITH {EV}, p AS (SELECT user_id, ms // 86400000 * 86400000 AS day, count(*) AS local, min(CASE WHEN value < 1 THEN 0 ELSE 1 END) AS drained FROM e GROUP BY 1, 2)
SELECT day, CAST(sum(local) AS BIGINT) AS local, min(drained) AS drained, count(*) FILTER (drained = 0) AS open FROM p GROUP BY day""")
def coverage_by_day(spark, d):
    p = events(spark, d).groupBy("user_id", tx.day_start("ms").alias("day")).agg(F.count("*").alias("local"), F.min(F.when(F.col("value") < 1, 0).otherwise(1)).alias("drained"))
    return p.groupBy("day").agg(F.sum("local").alias("local"), F.min("drained").alias("drained"), F.count_if(F.col("drained") == 0).alias("open"))


@query("funnel", """
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem) AS n_lines, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_parts,
round((SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) / (SELECT count(*) FROM orders), 6) AS done_ratio""")
def funnel(spark, d):
    o = read(spark, d, "orders").agg(F.count("*").alias("n_orders"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("done_ratio"))
    li = read(spark, d, "lineitem").agg(F.count("*").alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
    return o.crossJoin(li).select("n_orders", "n_lines", "n_parts", "done_ratio")  # one row each


@query("conversation_classes", """
WITH m AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS automated, count(*) FILTER (event_type = 'purchase') AS own, bool_or(value > 300) AS flagged FROM events GROUP BY user_id)
SELECT class, count(*) AS n FROM (SELECT CASE WHEN flagged THEN 'bot' WHEN automated = n THEN 'automated' WHEN own = 0 THEN 'silent' WHEN own * 5 > n THEN 'active' ELSE 'normal' END AS class FROM m) GROUP BY class""")
def conversation_classes(spark, d):
    m = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("automated"), F.count_if(mine()).alias("own"), F.bool_or(F.col("value") > 300).alias("flagged"))
    said = F.when(F.col("flagged"), "bot").when(F.col("automated") == F.col("n"), "automated").when(F.col("own") == 0, "silent").when(F.col("own") * 5 > F.col("n"), "active").otherwise("normal")
    return m.groupBy(said.alias("class")).agg(F.count("*").alias("n"))


@query("entity_fold", """
WITH m AS (SELECT trim(p_name) AS name, p_type AS entity_type, epoch_ms(l_shipdate) AS ms, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT lower(name) AS form, arg_min(name, ordinal) AS name, arg_min(entity_type, ordinal) AS entity_type, arg_min(ms, ordinal) AS first_seen, count(*) AS mention_count, max(ms) AS last_seen
FROM (SELECT *, ordinal * 100000 + dense_rank() OVER (ORDER BY name, entity_type, ms) AS o2 FROM m) GROUP BY 1""".replace("ordinal)", "o2)"))
def entity_fold(spark, d):
    li = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    rows = li.select("p_name", "p_type", millis("l_shipdate").alias("ms"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    ranked = rows.withColumn("order", F.struct("ordinal", "p_name", "p_type", "ms"))
    return ms.fold_entities(ranked, F.col("p_name"), "order", "ms", "p_type")


@query("description_fold", """
WITH o AS (SELECT conv_id, text, min(turn) AS t FROM conversations GROUP BY 1, 2)
SELECT conv_id, count(*) AS n_texts, string_agg('- ' || text, chr(10) ORDER BY t) AS description FROM o GROUP BY conv_id""")
def description_fold(spark, d):
    return ms.description(read(spark, d, "conversations"), "conv_id", ["turn"], "text")


@query("type_pool", """
WITH n AS (SELECT p_type, p_name, count(*) AS mentions FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY mentions DESC, p_name) AS r FROM n) SELECT p_type, string_agg(p_name, ',' ORDER BY r) AS names FROM r WHERE r <= 10 GROUP BY p_type""")
def type_pool(spark, d):
    counts = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    n = read(spark, d, "part").join(counts, "p_partkey").groupBy("p_type", "p_name").agg(F.sum("n").alias("mentions"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("mentions"), "p_name"))).where("r <= 10")
    return r.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_name"))), lambda x: x["p_name"]), ",").alias("names"))


@query("largest_gap", f"""
WITH {EV}, g AS (SELECT user_id, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap_start, ms AS gap_end FROM e)
SELECT user_id, gap_start, gap_end, gap_end - gap_start AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap_end - gap_start DESC, gap_start) AS r FROM g WHERE gap_end - gap_start > 86400000) WHERE r = 1""")
def largest_gap(spark, d):
    return ms.interior_gap(events(spark, d), "ms", 86_400_000, ["user_id"])


@query("keep_newest_n", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 20 AND event_type <> 'signup'")
def keep_newest_n(spark, d):
    return ms.beyond_cap(read(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20, F.col("event_type") == "signup").select("event_id")


@query("revision_retention", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS b, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n > 4 AND a > 3 AND b > 1""")
def revision_retention(spark, d):
    return ms.prunable_revisions(read(spark, d, "events"), ["user_id", "event_type"], "event_id").select("event_id")


SESSIONS = """, g AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS was FROM e),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR ms - was >= 10800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS session FROM g)"""


@query("idle_gap_sessions", f"WITH {EV}{SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, min(ms) AS started, max(ms) AS ended, count(*) AS n FROM s GROUP BY 1, 2")
def idle_gap_sessions(spark, d):
    s = ms.with_sessions(events(spark, d).select("user_id", "event_id", "ms"), "user_id", "ms", "event_id")
    return s.groupBy("user_id", "session").agg(F.min("ms").alias("started"), F.max("ms").alias("ended"), F.count("*").alias("n"))


@query("temporal_chain", f"WITH {EV}{SESSIONS} SELECT * FROM (SELECT user_id, CAST(session AS BIGINT) AS session, event_id AS source, lead(event_id) OVER (PARTITION BY user_id, session ORDER BY ms, event_id) AS target FROM s) WHERE target IS NOT NULL")
def temporal_chain(spark, d):
    s = ms.with_sessions(events(spark, d).select("user_id", "event_id", "ms"), "user_id", "ms", "event_id")
    return ms.chain(s, ["user_id", "session"], ["ms", "event_id"], "event_id")


@query("initiator_ratio", """
SELECT round(avg(CASE WHEN first_role = 'user' THEN 1.0 ELSE 0.0 END), 6) AS initiative, count(*) AS n FROM (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id)""")
def initiator_ratio(spark, d):
    first = read(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))
    return first.agg(F.round(F.avg((F.col("first_role") == "user").cast("double")), 6).alias("initiative"), F.count("*").alias("n"))


@query("neighbor_context", """
SELECT conv_id, turn, len(list_filter([lag(text, 3) OVER w, lag(text, 2) OVER w, lag(text, 1) OVER w, lead(text, 1) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w], lambda x: x IS NOT NULL)) AS n_context,
md5(concat_ws('|', lag(text, 3) OVER w, lag(text, 2) OVER w, lag(text, 1) OVER w, lead(text, 1) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w)) AS context_md5
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbor_context(spark, d):
    rows = ms.neighbours(read(spark, d, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.size("context").cast("long").alias("n_context"), F.md5(F.array_join(F.transform("context", lambda x: x["value"]), "|").cast("binary")).alias("context_md5"))


@query("rolling_rate_limit", f"""
WITH {EV}, r AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS last_hour, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS last_day FROM e)
SELECT event_id, last_hour, last_day, last_hour < 2 AND last_day < 6 AS allowed FROM r""")
def rolling_rate_limit(spark, d):
    r = ms.recent_counts(ms.recent_counts(events(spark, d).select("event_id", "user_id", "ms"), ["user_id"], "ms", 3_600_000, "last_hour"), ["user_id"], "ms", 86_400_000, "last_day")
    return r.select("event_id", "last_hour", "last_day", ((F.col("last_hour") < 2) & (F.col("last_day") < 6)).alias("allowed"))


@query("tumbling_tasks", f"WITH {EV} SELECT event_type, ms // 21600000 * 21600000 AS window_start, ms // 21600000 * 21600000 + 21600000 AS window_end, count(*) AS n FROM e GROUP BY 1, 2, 3")
def tumbling_tasks(spark, d):
    return ms.tumbling(events(spark, d), "ms", 21_600_000, ["event_type"])


@query("token_budget_prefix", """
WITH t AS (SELECT source, doc_id, CAST(ceil(n_chars / 1.5) AS BIGINT) AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY tokens DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM t)
SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 16000""")
def token_budget_prefix(spark, d):
    t = read(spark, d, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 1.5).alias("tokens"))
    return ms.token_prefix(t, ["source"], [F.desc("tokens"), F.col("doc_id")], "tokens", 16_000).select("source", "doc_id", "used")


@query("cursor_page", """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(position AS INTEGER) AS position, total, total > 4 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS position, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem) WHERE position BETWEEN 3 AND 4""")
def cursor_page(spark, d):
    return ms.page(read(spark, d, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")], 2, 2).select("l_orderkey", "l_partkey", "l_linenumber", "position", "total", "has_more")


@query("merged_page", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def merged_page(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", "ts")
    return ms.merged_page([e.where("event_type = 'click'"), e.where("event_type = 'view'")], [F.desc("ts"), F.col("event_id")], 50, 25).select("event_id", "event_type")


@query("keyset_page", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND event_id > 1000 ORDER BY event_id LIMIT 100")
def keyset_page(spark, d):
    return read(spark, d, "events").where("event_type = 'error' and event_id > 1000").orderBy("event_id").limit(100).select("event_id", "user_id")


@query("json_path_rollup", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_path_rollup(spark, d):
    return read(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("day_bucket", "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def day_bucket(spark, d):
    return events(spark, d).groupBy(tx.local_day("ms", OFFSET).alias("day")).agg(F.count("*").alias("n"))


@query("date_prefix", "SELECT event_id, '[' || strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') || '] ' || event_type AS said FROM events")
def date_prefix(spark, d):
    return events(spark, d).select("event_id", tx.dated("event_type", "ms").alias("said"))


@query("epoch_normalize", "SELECT event_id, (epoch_us(ts) // 1000) // 1000 * 1000 AS from_seconds, (epoch_us(ts) // 1000) AS from_millis, (epoch_us(ts) // 1000) // 1000 * 1000 AS from_text FROM events")
def epoch_normalize(spark, d):
    e = events(spark, d)
    said = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", tx.epoch_ms(F.floor(F.col("ms") / 1000)).alias("from_seconds"), tx.epoch_ms("ms").alias("from_millis"), tx.epoch_ms(said).alias("from_text"))


@query("work_hours", "SELECT event_type, count(*) AS n FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) >= 9 AND hour(ts) < 19 GROUP BY 1")
def work_hours(spark, d):
    return events(spark, d).where(tx.in_work_hours("ms")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("edge_delta", """
WITH o AS (SELECT l_orderkey, l_partkey, round(sum(l_discount), 4) AS w FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2), n AS (SELECT l_orderkey, l_partkey, round(sum(l_discount), 4) AS w FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2)
SELECT CASE WHEN n.w IS NULL THEN 'deleted' WHEN o.w IS NULL THEN 'inserted' ELSE 'reweighted' END AS change, count(*) AS n FROM o FULL JOIN n ON o.l_orderkey = n.l_orderkey AND o.l_partkey = n.l_partkey WHERE n.w IS NULL OR o.w IS NULL OR abs(n.w - o.w) > 1e-12 GROUP BY 1""")
def edge_delta(spark, d):
    li = read(spark, d, "lineitem")
    side = lambda k: li.where(F.col("l_linenumber") != k).groupBy("l_orderkey", "l_partkey").agg(F.round(F.sum("l_discount"), 4).alias("w"))
    return ms.edge_delta(side(1), side(2), ["l_orderkey", "l_partkey"], "w").groupBy("change").agg(F.count("*").alias("n"))


@query("count_by_key", "SELECT 'returnflag' AS kind, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2")
def count_by_key(spark, d):
    count = lambda t, c, k: read(spark, d, t).groupBy(F.lit(k).alias("kind"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return count("lineitem", "l_returnflag", "returnflag").unionByName(count("documents", "lang", "lang")).unionByName(count("events", "event_type", "event_type"))


@query("ratio_aggregates", "SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) FILTER (quality IS NOT NULL), 6) AS good_ratio, count(*) FILTER (quality IS NULL) AS unjudged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def ratio_aggregates(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("good_ratio"), F.count_if(F.col("quality").isNull()).alias("unjudged"))


@query("task_progress", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def task_progress(spark, d):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(is_("F").alias("done"), is_("O").alias("open"), is_("P").alias("pending"))


@query("spaces_rollup", "SELECT coalesce(source, '') AS space, count(*) AS n FROM documents GROUP BY 1")
def spaces_rollup(spark, d):
    return read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("space")).agg(F.count("*").alias("n"))


@query("top_distributions", "SELECT * FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)")
def top_distributions(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


@query("document_coverage", "SELECT source, CAST(epoch_ms(o_orderdate) // 86400000 AS BIGINT) % 7 AS day, count(*) AS n FROM documents JOIN orders ON o_orderkey = doc_id GROUP BY 1, 2")
def document_coverage(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.floor(millis("o_orderdate") / 86_400_000) % 7).alias("day"))
    return read(spark, d, "documents").select("doc_id", "source").join(o, "doc_id").groupBy("source", "day").agg(F.count("*").alias("n"))


@query("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("task_claim", """
WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'done' END AS state, user_id % 5 AS attempts, (epoch_us(ts) // 1000) AS t_ms FROM events)
SELECT event_id, state FROM t WHERE state = 'pending' OR (state = 'failed' AND attempts < 3) OR (state = 'running' AND t_ms < 1706000000000 - 1800000) ORDER BY event_id LIMIT 50""")
def task_claim(spark, d):
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("done")
    t = events(spark, d).select("event_id", state.alias("state"), (F.col("user_id") % 5).alias("attempts"), "ms")
    ready = (F.col("state") == "pending") | ((F.col("state") == "failed") & (F.col("attempts") < 3)) | ((F.col("state") == "running") & (F.col("ms") < 1_706_000_000_000 - 1_800_000))
    return t.where(ready).orderBy("event_id").limit(50).select("event_id", "state")
