"""Reading around entities, facts and communities: resolution, hydration, cards, context, local sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .messages import interval_neighbours, token_prefix
from .retrieval import checked_broadcast, top_k


def resolve_names(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """P10: (query, entity): the exact id, else the exact name, else a substring; ties by mentions, then id. ``queries``: (query)."""
    q = checked_broadcast(queries.select("query"), 10_000)
    name, want = F.lower("name"), F.lower(F.trim("query"))
    prio = F.when(F.col("entity").cast("string") == F.trim("query"), 0).when(name == want, 1).when(name.contains(want) & (want != ""), 2)
    hits = entities.join(q, (F.col("entity").cast("string") == F.trim("query")) | name.contains(want)).withColumn("prio", prio).where("prio is not null")
    return top_k(hits, "query", [F.col("prio"), F.desc("mentions"), F.col("entity")], 1).select("query", "entity")


def level_columns(assignments: DataFrame, levels: list[int]) -> DataFrame:
    """One row a node with a column for each level; a level that a node lacks is null in its own column."""
    return assignments.groupBy("node").pivot("level", levels).agg(F.min("cid")).withColumnsRenamed({str(n): f"community_L{n}" for n in levels})


def hydrate(refs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(node_type, node, label) of typed references; unknown ones are dropped. ``tables``: node type to (node, label)."""
    known = None
    for kind, table in tables.items():
        part = table.select(F.lit(kind).alias("node_type"), F.col("node"), F.col("label"))
        known = part if known is None else known.unionByName(part)
    return refs.select("node_type", "node").distinct().join(known, ["node_type", "node"])


def stance_facts(facts: DataFrame, units: DataFrame, chunk_units: DataFrame, about: DataFrame, entities: DataFrame, owner: Column) -> DataFrame:
    """Distinct (fact, entity, name) of decisions, causes and opinions that come from the owner's own units."""
    own = chunk_units.join(units.where(owner), "unit").select("chunk", "unit").distinct()
    kept = facts.where(F.col("fact_type").isin("DECISION", "CAUSAL", "OPINION")).join(own, "chunk")
    return kept.join(about, "fact").join(entities.select("entity", "name"), "entity").select("fact", "entity", "name").distinct()


def fact_conversations(facts: DataFrame, chunks: DataFrame, path: str = "$.conversation_id", namespace: str = ":") -> DataFrame:
    """(fact, conversation) with the namespace prefix off."""
    raw = F.get_json_object("metadata", path)
    return facts.join(chunks.select("chunk", "metadata"), "chunk").select("fact", F.substring_index(raw, namespace, -1).alias("conversation")).where("conversation is not null").distinct()


def in_conversation(candidates: DataFrame, members: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of a conversation; the scope is joined first, so nothing has to be fetched beyond the limit."""
    return candidates.join(members.select(key).distinct(), key, "left_semi").orderBy(*order).limit(limit)


def entity_card(entity, entities: DataFrame, edges: DataFrame, facts: DataFrame, similar: DataFrame, assignments: DataFrame, limit: int = 20, most_facts: int = 5) -> DataFrame:
    """One row: name, degree, top edges, facts, similar entities and communities of an entity."""
    me = entities.where(F.col("entity") == F.lit(entity)).select("entity", "name")
    near = edges.where((F.col("source") == F.lit(entity)) | (F.col("target") == F.lit(entity)))
    top = near.orderBy(F.desc("weight"), "source", "target").limit(limit).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), F.when(F.col("source") == F.lit(entity), F.col("target")).otherwise(F.col("source")).alias("node")))).alias("t"))
    said = facts.where(F.col("entity") == F.lit(entity)).orderBy(F.desc("ms"), "fact").limit(most_facts).agg(F.sort_array(F.collect_list(F.struct("ms", "fact")), asc=False).alias("f"))
    alike = similar.where((F.col("a") == F.lit(entity)) | (F.col("b") == F.lit(entity))).agg(F.sort_array(F.collect_set(F.when(F.col("a") == F.lit(entity), F.col("b")).otherwise(F.col("a")))).alias("similar"))
    where = assignments.where(F.col("node") == F.lit(entity)).agg(F.array_sort(F.collect_list(F.struct("level", "cid"))).alias("communities"))
    out = me.crossJoin(near.agg(F.count("*").alias("degree"))).crossJoin(top).crossJoin(said).crossJoin(alike).crossJoin(where)  # each is one row
    return out.select("entity", "name", "degree", F.transform("t", lambda x: x["node"]).alias("top_edges"), F.transform("f", lambda x: x["fact"]).alias("facts"), "similar", "communities")


def fact_context(facts: DataFrame, messages: DataFrame, within: int = 300_000, first: int = 7) -> DataFrame:
    """(fact, id, position): the messages around the message that each fact came from. ``facts``: (fact, message)."""
    at = facts.join(messages.select(F.col("id").alias("message"), "conversation", "ms"), "message").select(F.col("fact").alias("id"), "conversation", "ms", "message")
    near = interval_neighbours(at, messages.select("id", "conversation", "ms"), "conversation", "ms", within, first, "id")
    return near.where("l_message <> r_id").select(F.col("l_id").alias("fact"), F.col("r_id").alias("id"), "position")


def community_context(seeds: DataFrame, assignments: DataFrame, reports: DataFrame, budget: int = 16_000, share: float = 0.15) -> DataFrame:
    """Reports of the seeds' communities by matches, then rating, as far as the share of the budget goes."""
    hits = seeds.select(F.col("entity").alias("node")).join(assignments, "node").groupBy("level", "cid").agg(F.count("*").alias("matches"))
    rows = hits.join(reports, ["level", "cid"]).withColumn("tokens", tx.quarter_tokens("text")).withColumn("one", F.lit(1))
    return token_prefix(rows, ["one"], [F.desc("matches"), F.desc_nulls_last("rating"), F.col("level"), F.col("cid")], "tokens", int(budget * share)).drop("one")


def text_units(seeds: DataFrame, mentions: DataFrame, states: DataFrame, about: DataFrame, chunks: DataFrame, budget: int = 16_000, share: float = 0.5) -> DataFrame:
    """Chunks that mention seeds or state facts about them, by hits, then the seeds' score, as far as the share goes."""
    direct = seeds.select("entity", "score").join(mentions, "entity").select("chunk", "entity", "score")
    via = seeds.select("entity", "score").join(about, "entity").join(states, "fact").select("chunk", "entity", "score")
    hits = direct.unionByName(via).groupBy("chunk").agg(F.count("*").alias("hits"), F.max("score").alias("score"))
    rows = hits.join(chunks, "chunk").withColumn("tokens", tx.quarter_tokens("text")).withColumn("one", F.lit(1))
    return token_prefix(rows, ["one"], [F.desc("hits"), F.desc("score"), F.col("chunk")], "tokens", int(budget * share)).drop("one")


def browse(reports: DataFrame, level: int, k: int) -> DataFrame:
    """The largest communities of a level."""
    return reports.where(F.col("level") == level).orderBy(F.desc("member_count"), "cid").limit(k)


def activities(attempts: DataFrame, drafts: DataFrame, runs: DataFrame, messages: DataFrame) -> DataFrame:
    """Send attempts with their drafts, and the message that set each run off (null where it has been pruned)."""
    return attempts.join(drafts, "draft").join(runs, "run", "left").join(messages.select(F.col("id").alias("trigger"), F.col("text").alias("trigger_text")), "trigger", "left")


def interlocutors(private: DataFrame, group_chunks: DataFrame, own: DataFrame) -> DataFrame:
    """(peer, message): all own messages of a private chat; of groups those that share a chunk with the peer.
    ``private``: (conversation, peer); ``group_chunks``: (chunk, peer); ``own``: (message, conversation, chunks)."""
    one = own.join(private, "conversation").select("peer", "message")
    many = own.select("message", F.explode("chunks").alias("chunk")).join(group_chunks, "chunk").select("peer", "message")
    return one.unionByName(many).distinct()


def structural_maps(mentions: DataFrame, about: DataFrame) -> dict[str, DataFrame]:
    """The four maps between entities, chunks and facts."""
    sets = lambda df, k, v: df.groupBy(k).agg(F.sort_array(F.collect_set(v)).alias(f"{v}s"))
    return {"chunks_of_entity": sets(mentions, "entity", "chunk"), "entities_of_chunk": sets(mentions, "chunk", "entity"), "facts_of_entity": sets(about, "entity", "fact"), "entities_of_fact": sets(about, "fact", "entity")}


def latest_prior_run(ledger: DataFrame, current: str) -> DataFrame:
    """(level, run): each level's last run before the current one, from (run, seq, level); levels without members are in it too."""
    now = ledger.where(F.col("run") == current).agg(F.min("seq").alias("now"))  # one row
    return ledger.crossJoin(F.broadcast(now)).where(F.col("seq") < F.col("now")).groupBy("level").agg(F.max_by("run", "seq").alias("run"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with a graph as text, nodes and edges in order. For the few nodes of a walk."""
    short = lambda c: F.concat(F.lit("n"), F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 8))
    a = nodes.select(F.lit(0).alias("part"), tx.mermaid_node("node", "node_type", "label").alias("line"))
    b = edges.select(F.lit(1).alias("part"), F.concat(short("source"), F.lit(" -->|"), F.col("edge_type"), F.lit("| "), short("target")).alias("line"))
    return a.unionByName(b).distinct().agg(F.concat(F.lit("graph LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")).alias("graph"))


def churned_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """(community, added, removed, kept) from member arrays."""
    both = old.select("community", F.col("members").alias("was")).join(new.select("community", F.col("members").alias("now")), "community")
    size = lambda c: F.size(c).cast("long")
    return both.select("community", size(F.array_except("now", "was")).alias("added"), size(F.array_except("was", "now")).alias("removed"), size(F.array_intersect("was", "now")).alias("kept"))


def running_share(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """K3, K4: each row's running share of its key's total."""
    w = Window.partitionBy(*keys)
    return df.withColumn("running", F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(w))
