"""Column functions on text: tokens, normal forms, similarities, ids and time, all inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that are indexed as unigrams and bigrams, and the ASCII word characters.
CJK = r"぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
WORD = "A-Za-z0-9_+#.-"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- tokens


def tokenize(text: Column | str) -> Column:
    """Tokens in source order: ASCII words lower-cased; each CJK run as unigrams, each followed by its bigram. A text without CJK (and
    without the two letters beyond ASCII whose lower case has an ASCII letter) is read at once, not run by run."""
    runs = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"([{CJK}]+|[{WORD}]+)"), F.lit(1))

    def of(run: Column) -> Column:
        n = F.length(run)
        grams = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.array(F.substring(run, i, F.lit(1)), F.substring(run, i, F.lit(2)))).otherwise(F.array(F.substring(run, i, F.lit(1))))))
        return F.when(run.rlike(f"^[{CJK}]"), grams).otherwise(F.array(F.lower(run)))

    words = F.regexp_extract_all(F.lower(col(text)), F.lit(f"([{WORD}]+)"), F.lit(1))
    return F.when(F.coalesce(col(text).rlike(f"[{CJK}\u0130\u212a]"), F.lit(True)), F.flatten(F.transform(runs, of))).otherwise(words)


def index_segment(text: Column | str) -> Column:
    """Distinct tokens joined by blanks, first occurrence first."""
    return F.array_join(F.array_distinct(tokenize(text)), " ")


def query_tiers(text: Column | str) -> Column:
    """``[strict, relaxed]`` token lists; one list if relaxing (dropping CJK bigrams) changes nothing or leaves nothing; none without tokens."""
    strict = F.array_distinct(tokenize(text))
    relaxed = F.filter(strict, lambda t: ~t.rlike(f"^[{CJK}]{{2}}$"))
    both = (F.size(relaxed) > 0) & (F.size(relaxed) < F.size(strict))
    return F.when(F.size(strict) == 0, F.array().cast("array<array<string>>")).when(both, F.array(strict, relaxed)).otherwise(F.array(strict))


def quote_token(token: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(token, F.lit('"'), F.lit('""')), F.lit('"'))


def match_expression(tokens: Column | str) -> Column:
    """Quoted tokens joined by AND; an error for an empty list."""
    said = F.array_join(F.transform(col(tokens), quote_token), " AND ")
    return F.when(F.size(col(tokens)) > 0, said).otherwise(F.raise_error(F.lit("a match needs at least one token")))


# ---------------------------------------------------------------- normal forms


def half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic blank as their ASCII forms."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def normalize_query(text: Column | str) -> Column:
    """Half width, lower case, a blank between Latin and CJK, blanks collapsed; the stripped original if nothing stays."""
    t = F.lower(half_width(col(text)))
    t = F.regexp_replace(t, f"([a-z0-9])([{CJK}])", "$1 $2")
    t = F.regexp_replace(t, f"([{CJK}])([a-z0-9])", "$1 $2")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit("")), F.trim(col(text)))


def dedup_form(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def dedup_hash(text: Column | str) -> Column:
    """MD5 of the normal form; null for blank text, which is no duplicate of anything."""
    return F.when(dedup_form(text) != "", F.md5(dedup_form(text).cast("binary")))


PUNCTUATION = r"[\p{Punct}\s·、，。！？：；（）【】《》“”‘’—…]"


def without_punctuation(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(text), PUNCTUATION, ""))


def differs_only_by_punctuation(a: Column | str, b: Column | str) -> Column:
    return (without_punctuation(a) == without_punctuation(b)) & (col(a) != col(b)) & (without_punctuation(a) != "")


def normalize_answer(text: Column | str) -> Column:
    """Lower case, no punctuation, no articles, blanks collapsed (stems: see ``functions.python.stem``)."""
    t = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[\p{Punct}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the|and)\b", " "), r"\s+", " "))


# ---------------------------------------------------------------- similarities


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length; 1 if equal, 0 if one is empty."""
    a, b = col(a), col(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def phonetic_key(name: Column | str) -> Column:
    """(full, initials) without a pronunciation dictionary: lower-cased letters, and the first of each word."""
    low = F.lower(F.trim(col(name)))
    first = F.array_join(F.transform(F.split(low, r"\s+"), lambda w: F.substring(w, 1, 1)), "")
    return F.struct(F.regexp_replace(low, r"\s+", "").alias("full"), first.alias("initials"))


def array_jaccard(a: Column | str, b: Column | str) -> Column:
    return ratio(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b))))


def char_jaccard(a: Column | str, b: Column | str) -> Column:
    chars = lambda c: F.filter(F.array_distinct(F.split(col(c), "")), lambda x: x != "")
    return array_jaccard(chars(a), chars(b))


def overlap_coefficient(a: Column | str, b: Column | str) -> Column:
    return ratio(F.size(F.array_intersect(col(a), col(b))), F.least(F.size(col(a)), F.size(col(b))))


def structural_jaccard(a: Column | str, b: Column | str, least: int = 3) -> Column:
    return F.when(F.size(F.array_intersect(col(a), col(b))) >= least, array_jaccard(a, b)).otherwise(F.lit(0.0))


def conversation_overlap(a: Column | str, b: Column | str, least: int = 2) -> Column:
    return F.when(F.size(F.array_intersect(col(a), col(b))) >= least, overlap_coefficient(a, b)).otherwise(F.lit(0.0))


def churn(old: Column | str, new: Column | str, denominator: str = "baseline") -> Column:
    """Members added and removed, over: baseline (old), current (new), union or larger."""
    old, new = col(old), col(new)
    moved = F.size(F.array_except(new, old)) + F.size(F.array_except(old, new))
    by = {"baseline": F.size(old), "current": F.size(new), "union": F.size(F.array_union(old, new)), "larger": F.greatest(F.size(old), F.size(new))}[denominator]
    return F.when(by > 0, moved / by).otherwise(F.when(moved > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def facet_key(text: Column | str, first: int = 8) -> Column:
    """The first distinct tokens in ascending order, joined by blanks."""
    return F.array_join(F.slice(F.array_sort(F.array_distinct(tokenize(text))), 1, first), " ")


def facets_similar(a: Column | str, b: Column | str, least_ratio: float = 0.5, least_shared: int = 8) -> Column:
    x, y = F.array_distinct(tokenize(a)), F.array_distinct(tokenize(b))
    return (overlap_coefficient(x, y) >= least_ratio) & (F.size(F.array_intersect(x, y)) >= least_shared)


# ---------------------------------------------------------------- names, mentions, types


# Marks that end a mention, and mentions of everyone.
MARKS = "，。！？：、,.!?:；;"
BROADCASTS = ("所有人", "全体成员", "全体", "all", "here", "everyone", "channel")
# Patterns of opaque ids (a known prefix; a long run of mixed letters and digits), and of what no id has.
ID_PREFIX = r"^(lQ|lA)[A-Za-z0-9_-]{18,}$"
ID_BLOB = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d)[A-Za-z0-9]{20,}$"
HAN = r"[\u4e00-\u9fff]"


def clean_mention(name: Column | str) -> Column:
    """Without a leading ``@`` and trailing punctuation; null for broadcasts and media ids."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(col(name)), "^@", "")), f"[{MARKS}]+$", ""))
    return F.when((t == "") | F.lower(t).isin(*BROADCASTS) | is_media_id(t), F.lit(None)).otherwise(t)


def is_media_id(text: Column) -> Column:
    """Whether a name is an opaque id and not one of a person."""
    return ~text.rlike(HAN) & (text.rlike(ID_PREFIX) | text.rlike(ID_BLOB))


def media_ids(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?:mediaId|fileId)=([^)\s,\]]+)"), F.lit(1)))


def mention_texts(text: Column | str, longest: int = 24) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"@([^\s@()（）,，:：]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) <= longest))


def mentions_self(text: Column | str, names: Sequence[str]) -> Column:
    return F.arrays_overlap(mention_texts(text), F.array(*map(F.lit, names)))


def mapped(value: Column, known: Sequence[str], synonyms: Mapping[str, str], default: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ({k: k for k in known} | dict(synonyms)).items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


# Types and the synonyms mapped to them.
ENTITY_TYPES = ("Person", "Project", "Organization", "System", "Document", "Event", "Location", "Unknown")
ENTITY_SYNONYMS = {"Team": "Organization", "Concept": "Unknown", "Tool": "System", "Service": "System", "Platform": "System", "Product": "System", "Company": "Organization", "Department": "Organization", "Group": "Organization"}
FACT_TYPES = ("DECISION", "DELEGATE", "STATUS", "CAUSAL", "ACTION_ITEM", "OPINION", "EVENT", "GENERAL")
FACT_SYNONYMS = {"INFORMATION": "GENERAL", "FACT": "GENERAL", "TASK": "ACTION_ITEM", "TODO": "ACTION_ITEM", "ACTION": "ACTION_ITEM", "ASSIGNMENT": "DELEGATE", "UPDATE": "STATUS", "PROGRESS": "STATUS", "PLAN": "DECISION"}


def entity_type(raw: Column | str) -> Column:
    t = F.trim(col(raw))
    return mapped(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 10_000))), ENTITY_TYPES, ENTITY_SYNONYMS, "Unknown")


def fact_type(raw: Column | str) -> Column:
    return mapped(F.upper(F.trim(col(raw))), FACT_TYPES, FACT_SYNONYMS, "GENERAL")


# Patterns of facts in four groups, of which the first that matches wins.
FACT_PATTERNS = {
    "DECISION": ("决定.{2,}", "确定.{2,}(方案|计划|方向)", "采用.{2,}", "最终.{2,}", "定了.{2,}", "方案是.{2,}", "结论.{0,2}(是|：).{2,}"),
    "DELEGATE": (".{1,8}负责.{2,}", "你来.{2,}", "交给.{1,6}", ".{1,8}跟进.{2,}", ".{1,8}(owner|负责人)", "分工.{2,}"),
    "STATUS": (".{2,}完成了", ".{2,}(上线|发布)了?", ".{2,}(delay|postpone|延期)", "进度.{2,}", ".{2,}(搞定|done|完工)", "(目前|现在).{2,}(状态|进展|情况)", ".{2,}(blocked|卡住|阻塞)"),
    "CAUSAL": ("因为.{2,}所以.{2,}", ".{2,}导致.{2,}", ".{2,}影响.{2,}", "(原因|问题)(是|在于).{2,}"),
}


def rule_fact(text: Column | str, patterns: Mapping[str, Sequence[str]] = FACT_PATTERNS) -> Column:
    """struct(fact_type, text, confidence) of the first matching group; null for short, media-only and unmatched texts."""
    t = F.trim(col(text))
    kind = reduce(lambda c, kv: c.when(t.rlike("|".join(f"(?:{p})" for p in kv[1])), F.lit(kv[0])), list(patterns.items())[1:], F.when(t.rlike("|".join(f"(?:{p})" for p in next(iter(patterns.values())))), F.lit(next(iter(patterns)))))
    media = t.startswith("[图片消息]") | t.startswith("[语音消息]")
    return F.when((F.length(t) >= 8) & ~media & kind.isNotNull(), F.struct(kind.alias("fact_type"), F.substring(t, 1, 200).alias("text"), F.lit(0.8).alias("confidence")))


def rule_entities(text: Column | str, dictionary: Mapping[str, str] | None = None) -> Column:
    """array<struct(name, entity_type)>: dictionary tokens, @mentions, CamelCase, bracketed terms; the first rule that finds a name types it."""
    t = F.coalesce(col(text), F.lit(""))
    as_type = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("entity_type")))
    found = [
        as_type(F.filter(F.regexp_extract_all(t, F.lit(r"@([^\s@()（）,，:：]+)"), F.lit(1)), lambda n: F.length(n) >= 2), "Person"),
        as_type(F.filter(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1)), lambda n: F.length(n) >= 4), "System"),
        as_type(F.filter(F.regexp_extract_all(t, F.lit(r"[【《\[]([^】》\]]+)[】》\]]"), F.lit(1)), lambda n: F.length(n) >= 2), "Project"),
    ]
    if dictionary:
        words = F.array_intersect(F.regexp_extract_all(t, F.lit(r"([^\s\p{Punct}]+)"), F.lit(1)), F.array(*map(F.lit, dictionary)))
        known = F.create_map(*(F.lit(x) for kv in dictionary.items() for x in kv))
        found.insert(0, F.transform(words, lambda n: F.struct(n.alias("name"), F.element_at(known, n).alias("entity_type"))))
    every = F.concat(*found)
    return F.filter(every, lambda e, i: ~F.exists(F.slice(every, F.lit(1), i), lambda x: x["name"] == e["name"]))


def first_of(*columns: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(col(c)), F.lit("")) for c in columns))


# ---------------------------------------------------------------- ids (C20)

NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column | str, namespace: str = NAMESPACE_DNS) -> Column:
    """UUIDv5 of a name: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(col(name), "utf-8")))
    part = lambda i, n: F.substring(h, i, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def entity_id(name: Column | str) -> Column:
    return uuid5(F.concat(F.lit("entity:"), F.lower(F.trim(col(name)))))


# ---------------------------------------------------------------- time

DAY_MS = 86_400_000


def epoch_ms(value: Column | str, threshold: float = 1e12) -> Column:
    """Milliseconds of a number (seconds under ``threshold``), a numeric string, an ISO or naive time (UTC); 0 if none."""
    t = F.trim(col(value).cast("string"))
    n = t.try_cast("double")
    number = F.when(n <= 0, F.lit(0)).when(n < threshold, (n * 1000).cast("long")).otherwise(n.cast("long"))
    forms = [F.try_to_timestamp(t), *(F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss"))]
    return F.coalesce(F.when(n.isNotNull(), number), F.unix_millis(F.coalesce(*forms)), F.lit(0))


def local_day(ms: Column | str, offset_ms: int = 0) -> Column:
    """YYYY-MM-DD at a fixed offset from UTC."""
    return F.date_format(F.timestamp_millis(col(ms) + F.lit(offset_ms)), "yyyy-MM-dd")


def day_start(ms: Column | str, offset_ms: int = 0) -> Column:
    return F.floor((col(ms) + offset_ms) / DAY_MS).cast("long") * DAY_MS - offset_ms


def dated(text: Column | str, ms: Column | str, offset_ms: int = 8 * 3_600_000) -> Column:
    """``[YYYY-MM-DD] text``, once; as it is without a time."""
    done = col(text).rlike(r"^\[\d{4}-\d{2}-\d{2}\]")
    return F.when(done | col(ms).isNull() | (col(ms) <= 0), col(text)).otherwise(F.concat(F.lit("["), local_day(ms, offset_ms), F.lit("] "), col(text)))


def in_work_hours(ms: Column | str, offset_ms: int = 0, start: int = 9, end: int = 19) -> Column:
    at = F.timestamp_millis(col(ms) + F.lit(offset_ms))
    return F.dayofweek(at).between(2, 6) & (F.hour(at) >= start) & (F.hour(at) < end)


# ---------------------------------------------------------------- tokens of budgets, prompts


def chars_as_tokens(text: Column | str, per: float = 1.5) -> Column:
    return F.ceil(F.length(col(text)) / per)


def quarter_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4))


def clamp_citations(ids: Column | str, most: int = 5) -> Column:
    """``[a, b, +more]`` with the first ids."""
    head = F.array_join(F.slice(col(ids), 1, most), ", ")
    return F.concat(F.lit("["), head, F.when(F.size(col(ids)) > most, F.lit(", +more")).otherwise(F.lit("")), F.lit("]"))


def with_citations(text: Column | str, ids: Column | str, most: int = 5) -> Column:
    """The text's trailing bracket rewritten, or one appended; as it is without ids."""
    plain = F.regexp_replace(col(text), r"\s*\[[^\[\]]*\]\s*$", "")
    return F.when(F.size(col(ids)) > 0, F.concat_ws(" ", plain, clamp_citations(ids, most))).otherwise(col(text))


def looks_truncated(n: Column | str, limit: int) -> Column:
    return col(n) >= int(0.9 * limit)


def mermaid_node(node_id: Column | str, node_type: Column | str, label: Column | str) -> Column:
    """A node line; the shape tells the type; labels are escaped and cut to 40."""
    text = F.regexp_replace(F.regexp_replace(F.substring(col(label), 1, 40), r'"', "'"), r"[\[\]{}()<>|\n]", " ")
    shape = F.when(col(node_type) == "entity", F.concat(F.lit('("'), text, F.lit('")'))).when(col(node_type) == "fact", F.concat(F.lit('["'), text, F.lit('"]'))).otherwise(F.concat(F.lit('{{"'), text, F.lit('"}}')))
    return F.concat(F.lit("n"), F.substring(F.md5(col(node_id).cast("string").cast("binary")), 1, 8), shape)


# ---------------------------------------------------------------- JSON


def tolerant_json(text: Column | str) -> Column:
    """The JSON object in a model's answer as text: fences stripped, else from the first brace to the last; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{"), c)
    return F.coalesce(ok(bare), ok(F.nullif(inner, F.lit(""))))


def parse_points(text: Column | str) -> Column:
    """array<struct(text, score)> of ``{points: [...]}``: non-empty texts with an integer score from 0 to 100."""
    raw = F.from_json(tolerant_json(text), "struct<points:array<struct<text:string,description:string,score:string>>>")["points"]
    said = F.transform(raw, lambda p: F.struct(F.coalesce(p["text"], p["description"]).alias("text"), F.when(p["score"].rlike(r"^\d{1,3}$"), p["score"].cast("int")).alias("score")))
    return F.coalesce(F.filter(said, lambda p: (F.trim(p["text"]) != "") & p["score"].between(0, 100)), F.array().cast("array<struct<text:string,score:int>>"))


def report_problem(report: Column | str) -> Column:
    """Why a community report (struct of title, summary, rating, findings, tags) isn't valid; null if it is."""
    r = col(report)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rating = r["rating"]
    return F.when(blank(r["title"]), "title").when(blank(r["summary"]), "summary").when(rating.isNull() | F.isnan(rating) | ~rating.between(0, 10), "rating").when(~F.coalesce(F.size(r["findings"]), F.lit(0)).between(5, 10), "findings").when(~F.coalesce(F.size(r["tags"]), F.lit(0)).between(3, 5), "tags")


def split_messages(text: Column | str) -> Column:
    """A packed chunk's messages: each begins with a ``[time] sender:`` header line."""
    return F.filter(F.split(col(text), r"\n(?=\[[^\]\n]+\] [^:\n]+:)"), lambda m: F.trim(m) != "")


def header_body(message: Column) -> Column:
    return F.struct(F.regexp_extract(message, r"^(\[[^\]\n]+\] [^:\n]+:)", 1).alias("header"), F.trim(F.regexp_replace(message, r"^\[[^\]\n]+\] [^:\n]+:", "")).alias("body"))
