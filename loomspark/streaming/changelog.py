"""The change log and its consumers on Structured Streaming.

Every consumer is a streaming query of its own with its own checkpoint, which takes
the place of leases and cursors; what must be merged is written by ``foreachBatch``,
idempotent by batch id: a replayed batch overwrites the partition it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import DAY_MS

HOUR_MS, MINUTE_MS = 3_600_000, 60_000
# Pull windows, sessions, mailbox, retention and automatic builds.
OVERLAP_MS, LOOK_AHEAD_MS, FIRST_LOOK_BACK_MS = 2 * MINUTE_MS, 5 * MINUTE_MS, 7 * DAY_MS
QUIET_SECONDS, MOST_IN_TURN = 25, 30
PAYLOAD_DAYS, KEEP_REVISIONS, KEEP_CHANGES = 30, 3, 10_000
BUILD_LAG, BUILD_AGE_MS, BUILD_INTERVAL_MS = 500, DAY_MS, HOUR_MS


def source(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """One consumer pass: everything that has arrived, then stop. At least once; ``each`` is idempotent by batch."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def batch_sink(folder: str, *by: str) -> Callable[[DataFrame, int], None]:
    """A batch's rows in their own partition, overwritten if the batch is replayed."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def outbox(changed: Callable[[DataFrame, DataFrame | None], DataFrame], table: str, log: str) -> Callable[[DataFrame, int], None]:
    """Of a batch only what differs from the table so far goes to the table and, as changes, to the log. ``changed`` gets
    the batch and the table (None at first)."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        old = spark.read.parquet(table).where(F.col("batch") < batch) if _exists(spark, table) else None
        new = changed(rows, old)
        new.write.mode("overwrite").parquet(f"{table}/batch={batch}")
        new.select(F.lit("upsert").alias("op"), F.to_json(F.struct("*")).alias("payload")).write.mode("overwrite").parquet(f"{log}/batch={batch}")

    return write


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def deduplicated(df: DataFrame, keys: list[str], time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each key once. Without ``time`` no row is ever late (state grows with the keys); with it, keys are remembered for ``late``."""
    return df.dropDuplicates(keys) if time is None else df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(df: DataFrame, key: str, time: str, gap: str = "10799999 milliseconds", late: str = "1 hour") -> DataFrame:
    """Sessions of a key; a gap of 3 hours or more breaks, so the window's gap is one millisecond less."""
    return df.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def quiet_turns(df: DataFrame, key: str, time: str, quiet: int = QUIET_SECONDS, late: str = "1 minute") -> DataFrame:
    """Messages of a turn gathered until the conversation is quiet, in order, with the part of the turn (of 30 at most) each is in."""
    turn = df.withWatermark(time, late).groupBy(key, F.session_window(time, f"{quiet} seconds").alias("w")).agg(F.array_sort(F.collect_list(F.struct(time, "id"))).alias("messages"))
    return turn.select(key, F.col("w.start").alias("started"), F.transform("messages", lambda m, i: F.struct(m["id"].alias("id"), F.floor(i / MOST_IN_TURN).cast("int").alias("part"))).alias("messages"))


def tumbling(df: DataFrame, time: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts of keys in fixed windows."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def sliding(df: DataFrame, time: str, width: str, step: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def routed(df: DataFrame, scopes: DataFrame, key: str, time_ms: str) -> DataFrame:
    """Stream-static join; events from before a scope was enabled aren't routed."""
    return df.join(scopes.where("enabled").select(key, "enabled_at"), key).where(F.col(time_ms) >= F.col("enabled_at")).drop("enabled_at")


def probe_hints(probes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """T5: (key, reason): later message or more unread than known; a key that isn't probed any more was read."""
    k = known.select(key, F.col("last_ms").alias("k_last"), F.col("unread").alias("k_unread"))
    both = probes.join(k, key, "full_outer")
    reason = F.when(F.col("last_ms").isNull(), "read").when(F.col("k_last").isNull(), "new").when(F.col("last_ms") > F.col("k_last"), "later").when(F.col("unread") > F.col("k_unread"), "unread")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def index_changes(rows: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose normal text isn't indexed yet under their key."""
    from ..functions.text import dedup_hash

    new = rows.withColumn("content_hash", dedup_hash(text)).where("content_hash is not null")
    return new.join(index.select(key, "content_hash"), [key, "content_hash"], "left_anti")


# ---------------------------------------------------------------- control of pulls and builds


def next_window(watermark: int | None, now: int) -> tuple[int, int]:
    """Where to pull: a little before the watermark (a week back at first) to a little ahead of now."""
    return (now - FIRST_LOOK_BACK_MS if watermark is None else watermark - OVERLAP_MS), now + LOOK_AHEAD_MS


def merge_cursors(old: DataFrame, events: DataFrame) -> DataFrame:
    """(scope, watermark, floor): the watermark never falls, the floor never rises, failed windows change neither."""
    done = events.where("ok").groupBy("scope").agg(F.max("window_end").alias("end"), F.min("window_start").alias("start"))
    both = old.join(done, "scope", "full_outer")
    return both.select("scope", F.greatest("watermark", "end").alias("watermark"), F.least("floor", "start").alias("floor"))


def backfill_windows(floor: int, until: int, width: int) -> list[tuple[int, int]]:
    """T4: windows from the floor back to ``until``."""
    out = []
    while floor > until:
        out.append((max(until, floor - width), floor))
        floor = out[-1][0]
    return out


def bisected(start: int, end: int, count: Callable[[int, int], int], limit: int, least: int = MINUTE_MS) -> list[tuple[int, int]]:
    """Windows halved while a page looks cut off (90 % of its limit), down to a minute."""
    if count(start, end) < int(0.9 * limit) or end - start <= least:
        return [(start, end)]
    middle = (start + end) // 2
    return bisected(start, middle, count, limit, least) + bisected(middle, end, count, limit, least)


def adapted(interval: float, took: float, target: float, least: float = 1.0, most: float = 3600.0) -> float:
    """A polling interval half as long again if a poll was slow, as much shorter if it was fast."""
    return min(most, max(least, interval * 1.5 if took > target else interval / 1.5))


def consumer_order(needs: dict[str, list[str]]) -> list[str]:
    """Consumers after what they need; an error names a cycle."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str, way: list[str]) -> None:
        if state.get(name) == 1:
            raise ValueError("consumers need each other: " + " -> ".join([*way[way.index(name) :], name]))
        if name not in state:
            state[name] = 1
            for n in sorted(needs.get(name, [])):
                visit(n, [*way, name])
            state[name] = 2
            out.append(name)

    for n in sorted(needs):
        visit(n, [])
    return out


def run_cycle(needs: dict[str, list[str]], handlers: dict[str, Callable[[], None]]) -> dict[str, str]:
    """All consumers in order; one that fails stops those that need it, not the others."""
    result: dict[str, str] = {}
    for name in consumer_order(needs):
        if any(result.get(n) != "done" for n in needs.get(name, [])):
            result[name] = "skipped"
            continue
        try:
            handlers[name]()
            result[name] = "done"
        except Exception as e:
            result[name] = f"failed: {e}"
    return result


def build_decision(control: DataFrame) -> DataFrame:
    """``decision`` of (now, last_build, lag, failures, last_failure): first, lag, age, wait or idle, with back-off 30, 60, 120 minutes."""
    back_off = F.element_at(F.array(F.lit(30), F.lit(60), F.lit(120)), F.least("failures", F.lit(3))) * MINUTE_MS
    waiting = (F.col("failures") > 0) & (F.col("now") - F.col("last_failure") < back_off)
    since = F.col("now") - F.col("last_build")
    said = F.when(waiting, "wait").when(F.col("last_build").isNull(), F.when(F.col("lag") > 0, "first").otherwise("idle")).when(since < BUILD_INTERVAL_MS, "wait").when(F.col("lag") >= BUILD_LAG, "lag").when((since >= BUILD_AGE_MS) & (F.col("lag") > 0), "age").otherwise("idle")
    return control.withColumn("decision", said)


def retained_payloads(records: DataFrame, now: int, days: int = PAYLOAD_DAYS) -> DataFrame:
    """Payloads older than ``days`` are emptied; the rows stay."""
    return records.withColumn("payload", F.when(F.col("fetched_at") >= now - days * DAY_MS, F.col("payload")))


def prunable_changes(log: DataFrame, consumers: DataFrame, now: int, keep: int = KEEP_CHANGES) -> DataFrame:
    """Changes that every required, live consumer has acknowledged, beyond the newest ``keep``."""
    live = consumers.where(F.col("required") & ~F.col("needs_full_rebuild") & (F.lit(now) - F.col("heartbeat_at") <= F.col("stale_after_ms")))
    bound = live.agg(F.coalesce(F.min("acked_seq"), F.lit(0)).alias("acked"))
    head = log.agg(F.max("seq").alias("head"))
    limits = bound.crossJoin(head)  # one row
    return log.crossJoin(F.broadcast(limits)).where((F.col("seq") <= F.col("acked")) & (F.col("seq") <= F.col("head") - keep)).drop("acked", "head")


def improve_mode(requested: str, has_graph: bool, changed: int, total: int, dirty: bool) -> str:
    """Off, incremental or full from what is asked and what is stored."""
    if requested in ("off", "full"):
        return requested
    if not has_graph or dirty:
        return "full"
    if requested == "incremental" or (changed and changed * 4 <= total):
        return "incremental" if changed else "off"
    return "full" if changed else "off"
