"""Operators on message streams: filters, joins, sessions, windows and aggregates.

Columns are named by parameters; frames carry time as epoch milliseconds, where 0 or
less means unknown.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import DAY_MS, day_start

HOUR_MS = 3_600_000


# ---------------------------------------------------------------- filters


def corpus_predicate(text: str = "text", origin: str = "origin", eligible: str = "eligible") -> Column:
    """Text that isn't blank, not written by the agent, and not judged ineligible (null passes)."""
    return F.col(text).isNotNull() & (F.trim(F.col(text)) != "") & ~F.col(origin).eqNullSafe(F.lit("agent")) & ~F.col(eligible).eqNullSafe(F.lit(False))


def reject_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules))


def in_scope(df: DataFrame, scopes: DataFrame | None, key: str, time: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Rows of allowed conversations within [since, until]; ``scopes`` None is unrestricted, empty allows nothing."""
    if since is not None:
        df = df.where(F.col(time) >= since)
    if until is not None:
        df = df.where(F.col(time) <= until)
    return df if scopes is None else df.join(scopes.select(key).distinct(), key, "left_semi")


def route(df: DataFrame, scopes: DataFrame, key: str, time: str) -> DataFrame:
    """``routing`` of each row against (key, enabled, enabled_at)."""
    s = scopes.select(key, F.col("enabled").alias("__on"), F.col("enabled_at").alias("__at"), F.lit(True).alias("__in"))
    said = F.when(F.col("__in").isNull(), "not_in_scope").when(~F.coalesce("__on", F.lit(False)), "scope_disabled").when(F.col(time) < F.col("__at"), "before_enabled_at").otherwise("routed")
    return df.join(s, key, "left").withColumn("routing", said).drop("__on", "__at", "__in")


def payload_filter(df: DataFrame, conditions: dict) -> DataFrame:
    """P5: ``x_gte``, ``x_lte``, ``x_gt``, ``x_lt`` are ranges, lists are IN, scalars are equality; all hold."""
    for name, want in conditions.items():
        base, _, op = name.rpartition("_")
        ops = {"gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v}
        if op in ops and base:
            df = df.where(ops[op](F.col(base), F.lit(want)))
        else:
            df = df.where(F.col(name).isin(list(want)) if isinstance(want, (list, tuple, set)) else F.col(name) == want)
    return df


def like_escaped(column: Column, phrase: str) -> Column:
    """Substring match in which the phrase's wildcards are ordinary characters."""
    return column.contains(phrase)


def purge_victims(df: DataFrame, allowed: DataFrame | None, key: str, time: str, since: int | None, until: int | None, watched: DataFrame | None = None) -> DataFrame:
    """Rows outside the allow-list, before ``since``, or after ``until`` unless watched; nothing if unrestricted."""
    if allowed is None and since is None and until is None:
        return df.limit(0)
    bad = F.lit(False)
    if allowed is not None:
        df = df.join(allowed.select(key, F.lit(True).alias("__ok")).distinct(), key, "left")
        bad = bad | F.col("__ok").isNull()
    if since is not None:
        bad = bad | (F.col(time) < since)
    if until is not None:
        late = F.col(time) > until
        if watched is not None:
            df = df.join(watched.select(key, F.lit(True).alias("__seen")).distinct(), key, "left")
            late = late & F.col("__seen").isNull()
        bad = bad | late
    return df.where(bad).drop("__ok", "__seen")


# ---------------------------------------------------------------- joins over time


def interval_neighbours(left: DataFrame, right: DataFrame, key: str, time: str, within: int = 300_000, first: int = 7, order: str = "id") -> DataFrame:
    """For each left row, rows of the same key less than ``within`` away in time, the first by time.

    Both sides meet on (key, time bucket); a left row goes to its own bucket and both
    next to it, so a key with very many rows is many small joins.
    """
    lcols, rcols = [F.col(c).alias(f"l_{c}") for c in left.columns], [F.col(c).alias(f"r_{c}") for c in right.columns]
    bucket = F.floor(F.col(time) / within)
    a = left.select(*lcols, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    b = right.select(*rcols, bucket.alias("__b"))
    near = a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["__b"] == b["__b"])).where(F.abs(F.col(f"l_{time}") - F.col(f"r_{time}")) < within)
    w = Window.partitionBy(f"l_{order}").orderBy(f"r_{time}", f"r_{order}")
    return near.drop("__b").withColumn("position", F.row_number().over(w)).where(F.col("position") <= first)


def next_match(df: DataFrame, key: str, time: str, order: str, is_mine: Column) -> DataFrame:
    """With each row of others, the time of the next own row of the key (forward as-of join)."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)  # backwards: a frame that only grows
    known = df.where(F.col(time) > 0)
    return known.withColumn("reply_at", F.last(F.when(is_mine, F.col(time)), ignorenulls=True).over(w)).where(~is_mine)


def previous_latency(df: DataFrame, key: str, time: str, order: str, is_mine: Column) -> DataFrame:
    """Own rows whose previous row of the key isn't own, with the time between."""
    w = Window.partitionBy(key).orderBy(time, order)
    before = df.withColumn("__mine", is_mine).withColumn("__was", F.lag("__mine").over(w)).withColumn("latency", F.col(time) - F.lag(time).over(w))
    return before.where(F.col("__mine") & ~F.col("__was")).drop("__mine", "__was")


def still_open(items: DataFrame, replies: DataFrame, key: str, time: str) -> DataFrame:
    """Items without a later reply in their conversation (one maximum a conversation, no fan-out)."""
    last = replies.groupBy(key).agg(F.max(time).alias("__last"))
    return items.join(last, key, "left").where(F.col("__last").isNull() | (F.col("__last") <= F.col(time))).drop("__last")


def latest_per(df: DataFrame, key: str | list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row, as one grouped maximum."""
    keys = [key] if isinstance(key, str) else key
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__top"))
    return top.select(*keys, *(F.col("__top")[c].alias(c) for c in columns))


# ---------------------------------------------------------------- sessions and windows


def with_sessions(df: DataFrame, key: str, time: str, order: str, gap: int = 3 * HOUR_MS) -> DataFrame:
    """``session_start`` and ``session`` (from 0): a break at a gap of ``gap`` or more between known times."""
    w = Window.partitionBy(key).orderBy(time, order)
    before = F.lag(time).over(w)
    start = before.isNull() | ((before > 0) & (F.col(time) > 0) & (F.col(time) - before >= gap))
    marked = df.withColumn("session_start", start)
    return marked.withColumn("session", F.sum(F.col("session_start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def chain(df: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """(source, target) of consecutive nodes within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(node).alias("source"), F.lead(node).over(w).alias("target")).where("target is not null")


def neighbours(df: DataFrame, key: str, order: str, value: str, reach: int = 3) -> DataFrame:
    """Up to ``reach`` rows on either side with signed offsets, without the row itself."""
    w = Window.partitionBy(key).orderBy(order)
    around = [(d, F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w)) for d in range(-reach, reach + 1) if d]
    every = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(d).alias("offset"), c.alias("value"))) for d, c in around))
    return df.withColumn("context", F.array_compact(every))


def interior_gap(df: DataFrame, time: str, least: int, key: list[str] | None = None) -> DataFrame:
    """The largest gap over ``least`` between neighbours in time, per key."""
    keys = key or []
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = df.select(*keys, F.lag(time).over(w).alias("gap_start"), F.col(time).alias("gap_end")).withColumn("gap", F.col("gap_end") - F.col("gap_start")).where(F.col("gap") > least)
    best = F.max_by(F.struct("gap_start", "gap_end", "gap"), F.struct("gap", -F.col("gap_start"))).alias("b")
    return (gaps.groupBy(*keys).agg(best) if keys else gaps.agg(best).where("b is not null")).select(*keys, "b.*")


def beyond_cap(df: DataFrame, key: str, order: list[Column], cap: int, keep: Column | None = None) -> DataFrame:
    """Rows past the newest ``cap`` of their key, without those to keep."""
    numbered = df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where((F.col("position") > cap) & (~keep if keep is not None else F.lit(True)))


def prunable_revisions(df: DataFrame, key: list[str], order: str, newest: int = 3) -> DataFrame:
    """The middle of a chain of more than ``newest`` + 1 revisions: neither among the newest nor the oldest."""
    w = Window.partitionBy(*key)
    ranked = df.withColumn("__new", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("__old", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    return ranked.where((F.col("__n") > newest + 1) & (F.col("__new") > newest) & (F.col("__old") > 1)).drop("__new", "__old", "__n")


def first_in_list(df: DataFrame, list_id: str, item: str, rank: str) -> DataFrame:
    """The first occurrence of each item of a ranked list, ranked anew from 1."""
    best = df.groupBy(list_id, item).agg(F.min(rank).alias("__rank"))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(list_id).orderBy("__rank", item))).drop("__rank")


def recent_counts(df: DataFrame, key: list[str], time: str, within: int, name: str) -> DataFrame:
    """Rows of the key in the ``within`` milliseconds up to each row, itself included."""
    w = Window.partitionBy(*key).orderBy(time).rangeBetween(-within + 1, 0) if key else Window.orderBy(time).rangeBetween(-within + 1, 0)
    return df.withColumn(name, F.count("*").over(w))


def tumbling(df: DataFrame, time: str, width: int, keys: list[str]) -> DataFrame:
    """One row for each key and window of ``width``."""
    start = F.floor(F.col(time) / width).cast("long") * width
    return df.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("n")).withColumn("window_end", F.col("window_start") + width)


def token_prefix(df: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """K4: whole rows in order while their running sum stays within ``budget``; stops at the first that doesn't fit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def page(df: DataFrame, key: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """K6: rows ``offset`` + 1 to ``offset`` + ``limit`` of each key, with the total and whether there are more."""
    w = Window.partitionBy(*key)
    numbered = df.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return numbered.where(F.col("position").between(offset + 1, offset + limit)).withColumn("has_more", F.col("total") > offset + limit)


def merged_page(parts: list[DataFrame], order: list[Column], offset: int, limit: int) -> DataFrame:
    """K7: a page over several sources, of which each gives its first offset + limit rows."""
    out = None
    for part in parts:
        head = part.orderBy(*order).limit(offset + limit)
        out = head if out is None else out.unionByName(head, allowMissingColumns=True)
    return out.orderBy(*order).offset(offset).limit(limit)


# ---------------------------------------------------------------- aggregates


def day_trends(df: DataFrame, time: str, offset_ms: int, first_day: int, days: int, sums: dict[str, Column]) -> DataFrame:
    """A2: conditional counts for each of ``days`` local days from ``first_day`` (its start in ms), zeros where there is nothing."""
    spark = df.sparkSession
    spine = spark.range(days).select((F.lit(first_day) + F.col("id") * DAY_MS).alias("day"))
    some = df.where(F.col(time).between(first_day, first_day + days * DAY_MS - 1)).groupBy(day_start(time, offset_ms).alias("day")).agg(*(F.count_if(c).alias(n) for n, c in sums.items()))
    return spine.join(some, "day", "left").fillna(0, list(sums))


def trend_summary(trends: DataFrame, total: str) -> DataFrame:
    """The total, the mean of active days, the busiest day (the earlier of equals) and the empty days."""
    return trends.agg(
        F.sum(total).alias("total"), F.round(F.avg(F.when(F.col(total) > 0, F.col(total))), 6).alias("mean_active"),
        F.max_by("day", F.struct(F.col(total), -F.col("day"))).alias("busiest_day"), F.count_if(F.col(total) == 0).alias("empty_days"),
    )


def nearest_rank(values: Column, p: float) -> Column:
    """``sorted[round((n - 1) * p)]``, halves up; over an array column."""
    return F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * p + 0.5) + 1).cast("int"))


def mode_by(df: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Each key's most frequent value; of equals the latest, then the largest."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", "last", value)).alias("b")).select(key, "b.*")


def in_every(df: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """Members present in all groups (relational division), if there are ``least`` groups or more."""
    n = df.select(F.countDistinct(group).alias("n_groups"))
    per = df.groupBy(member).agg(F.countDistinct(group).alias("n"))
    return per.crossJoin(F.broadcast(n)).where((F.col("n") == F.col("n_groups")) & (F.col("n_groups") >= least)).select(member, "n_groups")  # n is one row


def fold_entities(mentions: DataFrame, name: Column, ordinal: str, time: str, kind: str, shortest: int = 2, longest: int = 50) -> DataFrame:
    """By normal form: mentions, last seen; display name, type and first seen come from the first row in input order."""
    known = mentions.withColumn("name", F.trim(name)).where(F.length("name").between(shortest, longest) & ~F.lower("name").rlike("^https?://") & ~F.lower("name").isin("all", "everyone", "here", "所有人"))
    first = F.min_by(F.struct(F.col("name"), F.col(kind).alias("entity_type"), F.col(time).alias("first_seen")), F.col(ordinal))
    out = known.groupBy(F.lower("name").alias("form")).agg(F.count("*").alias("mention_count"), F.max(time).alias("last_seen"), first.alias("f"))
    return out.select("form", "f.*", "mention_count", "last_seen")


def description(df: DataFrame, key: str, order: list[str], text: str, most: int = 12, longest: int = 512) -> DataFrame:
    """A10: distinct texts in time order; up to ``most`` as bullets, of more those within ``longest`` estimated tokens."""
    said = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))), lambda x: x["t"])
    folded = df.groupBy(key).agg(F.array_distinct(said).alias("texts"))
    start = F.struct(F.lit(0.0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        used = acc["used"] + F.ceil(F.length(t) / 1.5)
        fits = ~acc["full"] & (used <= longest)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (~fits).alias("full"), F.when(fits, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"))

    kept = F.when(F.size("texts") <= most, F.col("texts")).otherwise(F.aggregate("texts", start, step)["kept"])
    return folded.select(key, F.size("texts").cast("long").alias("n_texts"), F.array_join(F.transform(kept, lambda t: F.concat(F.lit("- "), t)), "\n").alias("description"))


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of (key, last_seen, mention_count, description): greatest time, added counts, the newer description."""
    o = old.select(key, *(F.col(c).alias(f"o_{c}") for c in ("last_seen", "mention_count", "description")))
    both = o.join(new, key, "full_outer")
    return both.select(key, F.greatest("o_last_seen", "last_seen").alias("last_seen"), (F.coalesce("o_mention_count", F.lit(0)) + F.coalesce("mention_count", F.lit(0))).alias("mention_count"), F.coalesce("description", "o_description").alias("description"))


def upsert_messages(old: DataFrame, new: DataFrame, keys: list[str], keep_greatest: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(all rows, changed rows). Nulls never overwrite; ``revision`` rises only with the text; unchanged rows aren't changes."""
    rest = [c for c in new.columns if c not in keys]
    both = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in rest), F.col("revision").alias("o_revision"), F.lit(True).alias("o_here")).join(new.dropDuplicates(keys), keys, "full_outer")
    merged = {c: F.greatest(c, f"o_{c}") if c in keep_greatest else F.coalesce(c, f"o_{c}") for c in rest}
    differs = F.lit(False)
    for c in rest:
        differs = differs | ~merged[c].eqNullSafe(F.col(f"o_{c}"))
    text_changed = F.col("o_here").isNotNull() & ~merged["content_text"].eqNullSafe(F.col("o_content_text")) if "content_text" in rest else F.lit(False)
    revision = F.when(F.col("o_here").isNull(), F.lit(1)).otherwise(F.col("o_revision") + text_changed.cast("int")).alias("revision")
    out = both.select(*keys, *(e.alias(c) for c, e in merged.items()), revision, (F.col("o_here").isNull() | differs).alias("__changed"))
    return out.drop("__changed"), out.where("__changed").drop("__changed")


def only_new(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't known, each key once."""
    return df.dropDuplicates(keys).join(known.select(*keys).distinct(), keys, "left_anti")


def edge_delta(old: DataFrame, new: DataFrame, keys: list[str], weight: str, tolerance: float = 1e-12) -> DataFrame:
    """U4: edges deleted, inserted or re-weighted between two snapshots."""
    o, n = old.select(*keys, F.col(weight).alias("old_weight")), new.select(*keys, F.col(weight).alias("new_weight"))
    change = F.when(F.col("new_weight").isNull(), "deleted").when(F.col("old_weight").isNull(), "inserted").when(F.abs(F.col("new_weight") - F.col("old_weight")) > tolerance, "reweighted")
    return o.join(n, keys, "full_outer").withColumn("change", change).where("change is not null")


# ---------------------------------------------------------------- small filters and orders

# Openings of messages that hold media only, and whole messages that only acknowledge.
MEDIA_OPENINGS = ("[图片消息]", "[语音消息]", "[视频消息]", "[文件]")
ACKNOWLEDGED = r"(?iu)^(好的?|ok|收到|嗯+|哈哈+|666|👍|💪|🙏|对的?|是的|行|可以|没问题|了解|明白|知道了|谢谢|thx|thanks)$"


def worth_extracting(text: Column) -> Column:
    """Whether a message says something: not media only, no bare acknowledgement, over three characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    media = F.lit(False)
    for opening in MEDIA_OPENINGS:
        media |= t.startswith(opening)
    return ~(media | t.rlike(ACKNOWLEDGED) | ((F.length(t) <= 3) & ~t.contains("\n")))


def active(entities: DataFrame, status: str = "quality_status") -> DataFrame:
    """Entities that aren't quarantined; a null status is not active."""
    return entities.where(F.col(status) == "active")


def recent_in_order(df: DataFrame, key: str, time: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key, numbered in reading order (``position`` from 1)."""
    newest = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc(order)))).where(F.col("__n") <= n)
    return newest.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__n")))).drop("__n")


def first_seen(items: Column) -> Column:
    """An array without repeats, in the order of first sight."""
    return F.array_distinct(items)
