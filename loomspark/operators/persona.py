"""Profile and policy operators: register and topic features, scene, send policy, gate, guards, evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .messages import next_match

# Phrases of the scene rules.
QUESTION_PHRASES = ("行吗", "可以吗", "好吗", "对吗", "是吗", "要不要", "能不能", "什么时候", "多少钱", "怎么办", "你看呢", "你觉得")
COMMITMENT_PHRASES = ("我来", "我负责", "我处理", "我搞定", "我改", "我加", "明天给", "今天给", "稍后给", "马上给", "没问题", "保证", "一定", "承诺", "答应")
PLACEHOLDER_PHRASES = ("这条需要人工确认后回复", "抱歉，我无法", "作为一个AI", "作为 AI", "我是一个语言模型")
MAX_AUTO_LENGTH = 60
MIN_CONFIDENCE, UNEVALUATED, PER_MINUTE, PER_HOUR = 0.75, -1.0, 5, 100

GREETING, CLOSING = r"(?i)^(hi|hello|hey|good (morning|afternoon|evening)|你好|您好|早|早上好|大家好)", r"(?i)(thanks|thank you|bye|regards|cheers|谢谢|辛苦了|再见|拜拜)[\s\p{Punct}。！]*$"
MARKERS = {
    "hedging_freq": ("maybe", "perhaps", "probably", "可能", "也许", "大概", "应该"), "directive_freq": ("please", "must", "should", "请", "麻烦", "必须", "务必"),
    "first_person_ratio": ("我", "我们"), "second_person_ratio": ("你", "您", "你们"), "auxiliary_ratio": ("会", "能", "可以", "要"), "conjunction_ratio": ("和", "但是", "因为", "所以", "而且"), "negation_ratio": ("不", "没", "别", "无"),
}
RATES = ("hedging_freq", "directive_freq")


def has_any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def marker_count(text: Column, markers) -> Column:
    total = F.lit(0)
    for m in markers:
        total = total + F.size(F.split(text, "(?-i)\\Q" + m + "\\E", -1)) - 1
    return total


def register_vector(messages: DataFrame, key: str, time: str, order: str, text: str, mine: Column) -> DataFrame:
    """21 measures of how the owner writes with each peer: one pass of sums and means, joined by three small per-key
    frames (latency, initiative, others' lengths)."""
    own = messages.where(mine & F.col(text).isNotNull() & (F.col(text) != ""))
    t = F.col(text)
    tokens = tx.tokenize(t)
    words = F.size(tokens)
    emoji = F.size(F.regexp_extract_all(t, F.lit("([\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}])"), F.lit(1)))
    mean_token = F.when(words > 0, F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x)) / words).otherwise(1.0)
    rate = lambda name: F.avg(marker_count(t, MARKERS[name]).cast("double"))
    per_token = lambda name: F.coalesce(F.try_divide(F.sum(marker_count(t, MARKERS[name])), F.sum(words)), F.lit(0.0))
    yes = lambda c: F.avg(c.cast("double"))
    a = own.groupBy(key).agg(
        F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_token / 4 - 0.1 * F.least(emoji / F.greatest(words, F.lit(1)), F.lit(1.0))))).alias("formality_score"),
        F.avg(F.length(t)).alias("avg_msg_length"), F.coalesce(F.stddev_pop(F.length(t)), F.lit(0.0)).alias("msg_length_variance"),
        F.coalesce(F.try_divide(F.sum(F.size(F.filter(tokens, lambda x: x.rlike(r"^[a-z0-9_+#.-]+$")))), F.sum(words)), F.lit(0.0)).alias("code_switch_ratio"), F.avg(emoji).alias("emoji_freq"),
        yes(t.rlike("[?？]")).alias("question_ratio"), yes(t.rlike(r"(\.\.\.|…)\s*$")).alias("ellipsis_ratio"), yes(t.rlike("[!！]")).alias("exclamation_ratio"),
        (F.sum(F.size(F.regexp_extract_all(t, F.lit(r"([\p{Punct}，。！？；：、])"), F.lit(1)))) / F.sum(F.length(t))).alias("punctuation_density"),
        *(rate(n).alias(n) for n in RATES), yes(F.trim(t).rlike(GREETING)).alias("greeting_freq"), yes(F.trim(t).rlike(CLOSING)).alias("closing_freq"), *(per_token(n).alias(n) for n in MARKERS if n not in RATES),
    )
    waited = next_match(messages, key, time, order, mine).groupBy(key).agg(F.coalesce(F.avg(F.col("reply_at") - F.col(time)), F.lit(0.0)).alias("response_latency"))
    lengths = messages.where(~mine).groupBy(key).agg(F.avg(F.length(text)).alias("__other"))
    first = messages.groupBy(key).agg(F.min_by(mine.cast("double"), F.struct(time, order)).alias("initiative_ratio"))
    out = a.join(waited, key, "left").join(lengths, key, "left").join(first, key, "left").fillna(0.0, ["response_latency", "initiative_ratio"])
    return out.withColumn("turn_length_ratio", F.coalesce(F.try_divide("avg_msg_length", F.col("__other")), F.lit(1.0))).drop("__other")


def topic_features(facts: DataFrame, topic: str, newest: int = 10) -> DataFrame:
    """Of facts (topic, fact, unit, ms, confidence): distinct units (null is one), newest facts, last time, mean confidence."""
    units = F.countDistinct("unit") + F.max(F.col("unit").isNull().cast("int"))
    ids = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ms", "fact")))), 1, newest), lambda x: x["fact"])
    return facts.groupBy(topic).agg(units.alias("evidence_count"), ids.alias("stance_fact_ids"), F.max("ms").alias("opinion_recency"), F.avg("confidence").alias("opinion_strength"))


def scene_failures(draft: Column, kind: Column, mentioned: Column) -> Column:
    """Rules that a draft fails, in order."""
    t = F.trim(draft)
    return F.array_compact(F.array(
        F.when((kind == "group") & ~mentioned, "is_direct_or_mentioned"), F.when(t.rlike("[?？]") | has_any(t, QUESTION_PHRASES), "no_question"), F.when(has_any(t, COMMITMENT_PHRASES), "no_commitment"),
        F.when((t == "") | (F.length(t) > MAX_AUTO_LENGTH), "within_length"), F.when(has_any(t, PLACEHOLDER_PHRASES), "no_placeholder"),
    ))


def risk(failures: Column) -> Column:
    return F.when(F.arrays_overlap(failures, F.array(*map(F.lit, ("no_commitment", "no_question", "no_placeholder")))), "high").when(F.size(failures) > 0, "medium").otherwise("low")


def policy_failures(df: DataFrame, now: str = "now") -> DataFrame:
    """``decision``, ``reason`` (of the first failed condition), ``failed`` (all of them, in order) and ``allowed``.

    Columns: dry_run, reply_mode, now, scene_failures, agent_allows, confidence, risk, draft, banned,
    sent_minute, sent_hour, kill_switch, revoked_at, expires_at. A dry run, and after it the mode
    "yolo", pass by all conditions. An unevaluated confidence (UNEVALUATED, or null) isn't a low one.
    """
    evaluated = F.coalesce(F.col("confidence"), F.lit(UNEVALUATED)) != UNEVALUATED
    checks = (
        ("mode_is_auto", F.when(F.col("reply_mode") != "auto", "mode_not_auto")),
        ("within_work_hours", F.when(~tx.in_work_hours(now), "outside_work_hours")),
        ("scene_allows_auto", F.when(F.size("scene_failures") > 0, "scene_disallows_auto")),
        ("agent_allows_auto", F.when(~F.col("agent_allows"), "agent_requires_review")),
        ("confidence_and_risk", F.when(evaluated & (F.col("confidence") < MIN_CONFIDENCE), "low_confidence").when(F.col("risk") != "low", "risk_not_low")),
        ("no_banned_phrase", F.when(F.exists("banned", lambda b: F.col("draft").contains(b)), "banned_phrase")),
        ("within_rate_limit", F.when((F.col("sent_minute") >= PER_MINUTE) | (F.col("sent_hour") >= PER_HOUR), "rate_limited")),
        ("kill_switch_inactive", F.when(F.col("kill_switch"), "kill_switch")),
        ("has_valid_grant", F.when(F.col("revoked_at").isNotNull(), "grant_missing").when(F.col("expires_at") <= F.col(now), "grant_expired")),
    )
    asked = ~F.col("dry_run") & (F.col("reply_mode") != "yolo")
    failed = F.array_compact(F.array(*(F.when(asked & reason.isNotNull(), name) for name, reason in checks)))
    reason = F.when(F.col("dry_run"), "dry_run").when(asked, F.coalesce(*(reason for _, reason in checks)))
    out = df.withColumns({"failed": failed, "reason": reason})
    return out.withColumn("allowed", F.col("reason").isNull()).withColumn("decision", F.when(F.col("allowed"), "auto_sent").otherwise("drafted"))


GATE = ("answer", "draft", "silent")


def gate(steps: Column) -> Column:
    """struct(verdict, reasons) of array<struct(verdict, reason)>: a verdict only ever falls, and every step that lowers it gives its reason."""
    rank = lambda v: F.array_position(F.array(*map(F.lit, GATE)), v)
    start = F.struct(F.lit(1).cast("long").alias("rank"), F.array().cast("array<string>").alias("reasons"))
    end = F.aggregate(steps, start, lambda acc, s: F.struct(F.greatest(acc["rank"], rank(s["verdict"])).alias("rank"), F.when(rank(s["verdict"]) > acc["rank"], F.concat(acc["reasons"], F.array(s["reason"]))).otherwise(acc["reasons"]).alias("reasons")))
    return F.struct(F.element_at(F.array(*map(F.lit, GATE)), end["rank"].cast("int")).alias("verdict"), end["reasons"].alias("reasons"))


def evidence_problems(facets: DataFrame, messages: DataFrame) -> DataFrame:
    """Facets (facet, evidence) with a ``problem``: no evidence, unknown evidence, or none of it the owner's own."""
    e = facets.select("facet", F.explode_outer("evidence").alias("id")).join(messages.select("id", "is_self", F.lit(True).alias("known")), "id", "left")
    per = e.groupBy("facet").agg(F.count("id").alias("n"), F.count("known").alias("n_known"), F.count_if(F.coalesce("is_self", F.lit(False))).alias("n_own"))
    said = F.when(F.col("n") == 0, "no_evidence").when(F.col("n_known") < F.col("n"), "unknown_evidence").when(F.col("n_own") == 0, "not_self")
    return per.select("facet", said.alias("problem")).where("problem is not null")


def identifying(text: Column) -> Column:
    """Whether a text still holds a mail address, a phone or identity number, or a long id."""
    return text.rlike(r"[\w.+-]+@[\w-]+\.\w+|(?<!\d)1[3-9]\d{9}(?!\d)|(?<!\d)\d{15,18}[\dXx]?(?!\d)")


# ---------------------------------------------------------------- evaluation


def token_f1(rows: DataFrame, key: str, truth: str, answer: str) -> DataFrame:
    """(key, f1): harmonic mean of precision and recall over the multiset of stemmed answer tokens."""
    from ..functions.python import stems

    words = lambda c: stems(F.filter(F.split(tx.normalize_answer(c), " "), lambda w: w != ""))
    both = rows.select(key, words(truth).alias("t"), words(answer).alias("a"))
    count = lambda c, n: both.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    common = count("t", "nt").join(count("a", "na"), [key, "w"]).groupBy(key).agg(F.sum(F.least("nt", "na")).alias("same"))
    out = both.join(common, key, "left").select(key, F.size("t").alias("nt"), F.size("a").alias("na"), F.coalesce("same", F.lit(0)).alias("same"))
    return out.select(key, F.when((F.col("nt") == 0) | (F.col("na") == 0), (F.col("nt") == F.col("na")).cast("double")).otherwise(2 * F.col("same") / (F.col("nt") + F.col("na"))).alias("f1"))


def evidence_recall(rows: DataFrame, key: str, gold: str, retrieved: str, k: int | None = None) -> DataFrame:
    """(key, recall, complete) of gold ids among the first ``k`` retrieved; questions without gold ids are left out."""
    found = F.col(retrieved) if k is None else F.slice(F.col(retrieved), 1, k)
    hits = F.size(F.array_intersect(F.col(gold), found))
    return rows.where(F.size(gold) > 0).select(key, (hits / F.size(F.array_distinct(gold))).alias("recall"), (hits == F.size(F.array_distinct(gold))).alias("complete"))


def ego_graph(links: DataFrame, entities: DataFrame, me: str, peers: int) -> DataFrame:
    """(a, b, weight, hop) around the most mentioned entity named ``me``: shared facts with its top peers, and among them."""
    from .graph import co_participation

    own = entities.where(F.col("name") == me).orderBy(F.desc("mentions"), "entity").limit(1).select("entity")
    mine = links.join(F.broadcast(own), "entity", "left_semi").select("fact")  # one row
    near = links.join(mine, "fact", "left_semi").join(F.broadcast(own), "entity", "left_anti").groupBy("entity").agg(F.countDistinct("fact").alias("weight")).orderBy(F.desc("weight"), "entity").limit(peers)
    kept = links.join(F.broadcast(near.select("entity")), "entity", "left_semi")  # ``peers`` rows
    first = near.crossJoin(F.broadcast(own.select(F.col("entity").alias("a")))).select("a", F.col("entity").alias("b"), "weight", F.lit(1).alias("hop"))
    return first.unionByName(co_participation(kept, "fact", "entity").select("a", "b", F.col("shared").alias("weight"), F.lit(2).alias("hop")))


def trends_window(df: DataFrame, time: str, key: str) -> DataFrame:
    """Each key's latest run before the current one, from a ledger that also records empty runs."""
    w = Window.partitionBy(key).orderBy(time)
    return df.withColumn("previous_run", F.lag("run").over(w))


def versioned_write(current: DataFrame, revisions: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current, revisions) after a write: replaced values go to the revisions, numbered by key; equal values change nothing."""
    n = new.select(*keys, F.col("value").alias("new_value"))
    both = current.join(n, keys, "full_outer")
    replaced = both.where("new_value is not null and value is not null and new_value <> value").select(*keys, "value")
    last = revisions.groupBy(*keys).agg(F.max("revision").alias("last"))
    numbered = replaced.join(last, keys, "left").select(*keys, "value", (F.coalesce("last", F.lit(0)) + 1).alias("revision"))
    return both.select(*keys, F.coalesce("new_value", "value").alias("value")), revisions.unionByName(numbered)
