"""Reading exported records (JSON lines) into chunks with lineage, and writing snapshots.

A chunk frame has (id, content, source_type, timestamp, source_ref, metadata as JSON).
Times are epoch milliseconds; 0 is unknown. Malformed lines and lines that aren't
objects are dropped by the scan; no schema is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import python as py, text as tx
from ..operators.messages import HOUR_MS, with_sessions

RECORD = "id string, scope_id string, type string, data string"
SCOPE = "id string, type string, parent_id string, data string"
CHUNK = ["id", "content", "source_type", "timestamp", "source_ref", "metadata"]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects line by line; nested values of string columns stay JSON text."""
    raw = spark.read.text(path).where("trim(value) <> ''").withColumn("v", F.try_parse_json("value")).where("v is not null and value rlike '^\\\\s*\\\\{'")
    columns = [c.strip().split(" ") for c in schema.split(",")]
    return raw.select(*(F.get_json_object("value", f"$.{name}").cast(kind).alias(name) for name, kind in columns)).where("id is not null")


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Scopes by id, each once."""
    s = read_jsonl(spark, f"{folder}/scopes.jsonl", SCOPE).dropDuplicates(["id"])
    return s.withColumn("title", tx.first_of(at("title"), at("name"), at("node.name"))).withColumn("chat_kind", at("chat_kind"))


def records(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    r = read_jsonl(spark, f"{folder}/records.jsonl", RECORD)
    return r if kind is None else r.where(F.col("type") == kind)


def at(path: str, column: str = "data") -> Column:
    return F.get_json_object(column, f"$.{path}")


def _metadata(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


def messages(rows: DataFrame, owner: str | None = None) -> DataFrame:
    """(id, conversation_id, sender, ms, header, body, is_self, reply_to, session_start, session): quote and body rendered, sessions marked."""
    ms = tx.epoch_ms(at("createTime"))
    quote = F.when(at("quotedMessage.content").isNotNull(), F.concat(F.lit("> "), F.coalesce(at("quotedMessage.sender"), F.lit("")), F.lit(": "), at("quotedMessage.content"), F.lit("\n"))).otherwise("")
    when = F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")).otherwise("")
    out = rows.where("type = 'message'").select(
        at("openMessageId").alias("id"), F.coalesce(at("openConversationId"), "scope_id").alias("conversation_id"), at("sender").alias("sender"), ms.alias("ms"),
        F.concat(F.lit("["), when, F.lit("] "), F.coalesce(at("sender"), F.lit("")), F.lit(":")).alias("header"), F.concat(quote, F.coalesce(at("content"), F.lit(""))).alias("body"),
        (at("sender") == F.lit(owner)).alias("is_self"), at("quotedMessage.openMessageId").alias("reply_to"),
    )
    return with_sessions(out.dropDuplicates(["id"]), "conversation_id", "ms", "id", 3 * HOUR_MS)


def message_slices(rows: DataFrame, budget: int = py.SLICE_TOKENS) -> DataFrame:
    """Whole messages packed into slices within their session, with the members' ids."""
    return py.slice_sessions(rows, ["conversation_id", "session"], ["ms", "id"], "body", "header", "id", budget)


def chat_edges(slices: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, target, edge_type): TEMPORAL within a session, REPLY_TO from the slice with a quote to the slice it quotes."""
    w = Window.partitionBy("conversation_id", "session").orderBy("slice")
    temporal = slices.select(F.col("slice_id").alias("source"), F.lead("slice_id").over(w).alias("target"), F.lit("TEMPORAL").alias("edge_type")).where("target is not null")
    holds = slices.select("slice_id", F.explode("members").alias("id"))
    replies = rows.where("reply_to is not null").select("id", "reply_to").join(holds.withColumnRenamed("slice_id", "source"), "id")
    replies = replies.join(holds.select(F.col("slice_id").alias("target"), F.col("id").alias("reply_to")), "reply_to").where("source <> target")
    return temporal.unionByName(replies.select("source", "target", F.lit("REPLY_TO").alias("edge_type"))).distinct()


def _parts(rows: DataFrame, kind: str, key: Column, text: Column, header: Column, ms: Column, ref: Column, budget: int, headings: bool) -> DataFrame:
    """Chunks of one record each: ``kind:key`` for one part, ``kind:key:i`` for several; the header is on every part."""
    made = rows.select(key.alias("key"), ms.alias("timestamp"), ref.alias("source_ref"), header.alias("header"), py.listed(lambda t: py.chunk_text(t, budget, headings=headings))(text).alias("parts"))
    one = made.select("*", F.posexplode("parts").alias("i", "part"))
    ident = F.concat_ws(":", F.lit(kind), "key", F.when(F.size("parts") > 1, F.col("i").cast("string")))
    body = F.when(F.coalesce(F.col("header"), F.lit("")) == "", F.col("part")).otherwise(F.concat_ws("\n", "header", "part"))
    return one.select(ident.alias("id"), body.alias("content"), F.lit(kind).alias("source_type"), "timestamp", "source_ref", _metadata(part=F.col("i"), parts=F.size("parts")).alias("metadata"))


def mail(rows: DataFrame) -> DataFrame:
    """S3: mails with subject or body; sender, receivers and time head every part."""
    m = rows.where("type = 'email'").withColumn("b", F.coalesce(at("body"), F.col("data")))
    b = lambda p: F.get_json_object("b", f"$.{p}")
    people = lambda p: F.array_join(F.transform(F.from_json(b(p), "array<struct<name:string,email:string>>"), lambda x: F.coalesce(x["name"], x["email"])), ", ")
    sender = F.coalesce(b("from.name"), b("from.email"), F.lit(""))
    header = F.concat_ws("\n", F.concat(F.lit("From: "), sender), F.concat(F.lit("To: "), people("toRecipients")), F.concat(F.lit("Cc: "), F.nullif(people("ccRecipients"), F.lit(""))), F.concat(F.lit("Time: "), b("receivedDateTime")))
    text = F.concat_ws("\n", F.nullif(b("subject"), F.lit("")), F.nullif(b("markdownBody"), F.lit("")))
    m = m.where(F.trim(text) != "")
    return _parts(m, "mail", F.coalesce(b("id"), at("messageId"), "id"), text, header, tx.epoch_ms(b("receivedDateTime")), b("conversationId"), py.PART_CHARS, False)


def wiki(rows: DataFrame) -> DataFrame:
    """Document units in heading-aware chunks; the id holds a UUIDv5 of the record's id; the time is always 0."""
    r = rows.where("type = 'document_unit'")
    node = tx.first_of(F.col("scope_id"), F.element_at(F.split(at("docUrl"), "/"), -1))
    return _parts(r, "wiki", F.concat_ws(":", node, tx.uuid5("id")), at("text"), F.lit(""), F.lit(0).cast("long"), at("docUrl"), py.DOCUMENT_CHARS, True)


def minutes(rows: DataFrame) -> DataFrame:
    """Per meeting a summary chunk (summary, keywords, distinct todos) and transcript chunks of ``speaker: text`` lines.
    Of summary, keywords and todos the last record wins; pages sort by their index; a meeting needs a summary or a page."""
    r = rows.where("type = 'minutes'").select("scope_id", "id", at("unit_kind").alias("kind"), at("page_index").cast("int").alias("page"), "data")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("data")), F.when(F.col("kind") == k, F.col("id")))
    pages = F.array_sort(F.collect_list(F.when(F.col("kind") == "transcript", F.struct("page", F.col("data")))))
    m = r.groupBy("scope_id").agg(last("summary").alias("summary"), last("keywords").alias("keywords"), last("todos").alias("todos"), pages.alias("pages")).where("summary is not null or size(pages) > 0")
    words = F.from_json(at("keywords", "keywords"), "array<string>")
    todos = F.array_distinct(F.from_json(at("todos", "todos"), "array<string>"))
    head = F.concat_ws("\n", at("text", "summary"), F.concat(F.lit("Keywords: "), F.array_join(words, ", ")), F.array_join(F.transform(todos, lambda t: F.concat(F.lit("- "), t)), "\n"))
    when = F.coalesce(tx.epoch_ms(at("started_at", "summary")), F.lit(0))
    lines = F.flatten(F.transform("pages", lambda p: F.coalesce(F.transform(F.from_json(F.get_json_object(p["data"], "$.lines"), "array<struct<speaker:string,text:string>>"), lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), F.array().cast("array<string>"))))
    summary = _parts(m.where("summary is not null"), "minutes", F.concat(F.col("scope_id"), F.lit(":summary")), head, F.lit(""), when, F.col("scope_id"), 1 << 30, False)
    pack = py.listed(lambda t: py.chunk_text(t, py.PART_CHARS, headings=False, delimiters=("\n",)))
    said = m.select("scope_id", when.alias("timestamp"), F.posexplode(pack(F.array_join(lines, "\n"))).alias("i", "content"))
    return summary.unionByName(said.select(F.concat_ws(":", F.lit("minutes"), "scope_id", F.col("i").cast("string")).alias("id"), "content", F.lit("minutes").alias("source_type"), "timestamp", F.col("scope_id").alias("source_ref"), _metadata(part=F.col("i")).alias("metadata")))


def generic(rows: DataFrame, kind: str) -> DataFrame:
    """Any other record: envelope unwrapped, its texts flattened, ``title · time`` on every part."""
    r = rows.where(F.col("type") == kind).withColumn("p", py.read_payload("data"))
    header = F.concat_ws(" · ", "p.title", "p.time")
    return _parts(r, kind, F.col("id"), F.array_join("p.texts", "\n"), header, tx.epoch_ms("p.time"), F.col("scope_id"), py.PART_CHARS, False)


def union_sources(*parts: DataFrame) -> DataFrame:
    """Chunks of all sources; a repeated id is one chunk."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["id"])


def fixed_windows(units: DataFrame, key: str, order: str, unit: str, text: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Windows over each key's joined units: (key, window, start, end, unit, unit_start, unit_end) with exact offsets.

    Offsets come from a running sum, windows from a range of numbers of each unit, so
    nothing is gathered: a unit knows which windows it overlaps.
    """
    step = size - overlap
    n = F.length(text)
    w = Window.partitionBy(key).orderBy(order)
    placed = units.select(key, unit, (F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("from"), n.alias("n"), F.sum(n).over(Window.partitionBy(key)).alias("total"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / step)).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("from") - size) / step) + 1).cast("long")
    until = F.least(last, F.floor((F.col("from") + F.col("n") - 1) / step)).cast("long")
    rows = placed.where("n > 0").withColumn("window", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<long>"))))
    start = F.col("window") * step
    end = F.least(start + size, F.col("total"))
    return rows.select(key, "window", start.alias("start"), end.alias("end"), unit, (F.greatest(start, F.col("from")) - F.col("from")).alias("unit_start"), (F.least(end, F.col("from") + F.col("n")) - F.col("from")).alias("unit_end")).where("unit_start < unit_end")


def reconstruct_units(units: DataFrame, pieces: DataFrame, key: list[str]) -> DataFrame:
    """Each unit's text: the longest whole candidate, else its distinct fragments in order. ``pieces``: (key, chunk_order, whole, text)."""
    whole = F.max_by(F.when(F.col("whole"), F.col("text")), F.when(F.col("whole"), F.length("text")))
    parts = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("chunk_order", "text")))), lambda x: x["text"])), "\n")
    return units.join(pieces, key).groupBy(*key).agg(F.coalesce(whole, parts).alias("text"))


def structural_edges(chunks: DataFrame, mentions: DataFrame, facts: DataFrame, scopes_of: DataFrame) -> DataFrame:
    """PART_OF, MENTIONS, STATES and ABOUT edges, each once."""
    edge = lambda df, a, b, st, tt, kind: df.select(F.lit(st).alias("source_type"), F.col(a).alias("source"), F.lit(tt).alias("target_type"), F.col(b).alias("target"), F.lit(kind).alias("edge_type"))
    about = facts.select("fact", F.explode(F.array_compact(F.array("subject", "object"))).alias("entity"))
    out = edge(scopes_of, "chunk", "scope", "chunk", "scope", "PART_OF").unionByName(edge(mentions.join(chunks.select("chunk"), "chunk", "left_semi"), "chunk", "entity", "chunk", "entity", "MENTIONS"))
    return out.unionByName(edge(facts, "chunk", "fact", "chunk", "fact", "STATES")).unionByName(edge(about, "fact", "entity", "fact", "entity", "ABOUT")).distinct()


def build_facts(raw: DataFrame) -> DataFrame:
    """Facts of (chunk, text, fact_type, ms, confidence, subject, object): dated text, id from content, confidence in [0, 1] (0.9 if none), each id once."""
    kind = tx.fact_type("fact_type")
    ident = tx.uuid5(F.concat_ws("|", F.lit("fact"), "chunk", kind, F.trim("text")))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.9))))
    return raw.where(F.trim("text") != "").select(ident.alias("fact"), tx.dated(F.trim("text"), "ms").alias("text"), kind.alias("fact_type"), F.col("ms").alias("timestamp"), sure.alias("confidence"), "subject", "object", "chunk").dropDuplicates(["fact"])


def write_snapshot(folder: str, scope_rows: DataFrame, record_rows: DataFrame) -> None:
    """A full snapshot as JSON lines, one folder for scopes and one for records."""
    scope_rows.write.mode("overwrite").json(f"{folder}/scopes")
    record_rows.write.mode("overwrite").json(f"{folder}/records")


def append_new(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str]) -> None:
    """Insert-or-ignore into a Parquet table."""
    try:
        known = spark.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        rows.dropDuplicates(keys).write.parquet(folder)
        return
    rows.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti").write.mode("append").parquet(folder)


def lru(cache: DataFrame, key: str, tick: str, most: int = 100_000) -> DataFrame:
    """The ``most`` last used rows of a cache, each key once (the last). A global order by tick, without a single-task window."""
    once = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), tick).alias("v")).select(key, "v.*")
    return once.orderBy(F.desc(tick), key).limit(most)


def embed_distinct(df: DataFrame, text: str, embed: Column | None = None, size: int = 64) -> DataFrame:
    """``embedding`` of each row, equal texts embedded once; null for a null text."""
    from ..functions.vectors import hash_embedding

    once = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("embedding", embed if embed is not None else hash_embedding(text, size))
    return df.join(once, text, "left")
