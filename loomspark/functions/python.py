"""Arrow functions for what no built-in expresses: chunkers, greedy packing, sequence ratio, stems, payload walkers, facet fold."""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Types are objects, not DDL, as workers import this module without a session.
STRINGS = T.ArrayType(T.StringType())

# Budgets in characters and tokens.
DOCUMENT_CHARS, PART_CHARS, SLICE_TOKENS = 1200, 1500, 1024
DELIMITERS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "，", ", ", " ")


def pack(sizes: Iterable[int], budget: int, drop_oversized: bool = False) -> list[int | None]:
    """Bin number of each item, filled in order; a full bin is never gone back to. An oversized item is
    dropped (None) or stands alone."""
    out: list[int | None] = []
    bin_, used = 0, 0
    for size in sizes:
        if size > budget and drop_oversized:
            out.append(None)
            continue
        if used and used + size > budget:
            bin_, used = bin_ + 1, 0
        out.append(bin_)
        used += size
    return out


def _segments(text: str, delimiters: tuple[str, ...]) -> Iterator[str]:
    """Parts that end with a delimiter (of several at one place the longest), and the rest."""
    ends = "|".join(map(re.escape, sorted(delimiters, key=len, reverse=True)))
    begin = 0
    for m in re.finditer(ends, text) if ends else ():
        yield text[begin : m.end()]
        begin = m.end()
    yield text[begin:]


def _spans(sizes: Iterable[int], budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Begin and end of chunks over segments of these sizes that follow each other. A chunk ends with the last segment that ends within
    ``budget`` of its begin, and has one new segment at least; the next one begins ``overlap`` before that end, but not before this one."""
    ends = list(accumulate(sizes))
    begin = done = 0
    while done < len(ends):
        done = max(done + 1, bisect_right(ends, begin + budget))
        yield begin, ends[done - 1]
        begin = max(begin, ends[done - 1] - overlap)


def chunk_text(text: str | None, budget: int = DOCUMENT_CHARS, overlap: int = 0, headings: bool = True, delimiters: tuple[str, ...] = DELIMITERS) -> list[str]:
    """Chunks of at most ``budget`` characters (and the overlap): headings of the first two levels begin one,
    then segments fill chunks in order; a segment over the budget is cut by length, in chunks of its own."""
    out: list[str] = []
    for section in re.split(r"(?m)^(?=#{1,2}\s)", text or "") if headings else [text or ""]:
        whole = len(section.strip()) <= budget
        segments = [section] if whole else [s for s in _segments(section, delimiters) if s.strip()]
        for long, run in groupby(segments, lambda s: not whole and len(s) > budget):
            parts = list(run)
            body = "".join(parts)
            if long:
                spans = ((at, min(at + budget, end)) for part, end in zip(parts, accumulate(map(len, parts)), strict=True) for at in range(end - len(part), end, budget))
            else:
                spans = _spans(map(len, parts), budget, overlap)
            out += (body[i:j].strip() for i, j in spans)
    return [c for c in out if c]


def delimiters_of(spec: str) -> tuple[list[str], list[str]]:
    """(hard, soft): delimiters in back ticks are hard, other characters soft."""
    hard = re.findall(r"`([^`]+)`", spec)
    return hard, list(dict.fromkeys(re.sub(r"`[^`]+`", "", spec)))


def merge_tokens(text: str | None, budget: int = 128, spec: str = "\n。；！？", overlap_percent: int = 0, count: Callable[[str], int] | None = None) -> list[str]:
    """Pieces merged up to a token budget; hard delimiters always cut; a chunk repeats the last percents of the one before."""
    count = count or (lambda s: max(1, len(s) // 4))
    hard, soft = delimiters_of(spec)
    blocks = re.split("|".join(map(re.escape, hard)), text or "") if hard else [text or ""]
    out: list[str] = []
    for block in blocks:
        if not block.strip():
            continue
        parts = [p for p in re.split("(?<=[" + re.escape("".join(soft)) + "])", block) if p] if soft else [block]
        current, used = "", 0
        for p in parts:
            n = count(p)
            if current and used + n > budget * (100 - overlap_percent) / 100:
                out.append(current)
                tail = current[len(current) * (100 - overlap_percent) // 100 :] if overlap_percent else ""
                current, used = tail + p, count(tail) + n if tail else n
            else:
                current, used = current + p, used + n
        if current:
            out.append(current)
    return [c.strip() for c in out if c.strip()]


def listed(f: Callable[[str | None], list[str]]):
    """A text function with a list result as an Arrow function."""

    @F.pandas_udf(STRINGS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f(None if t is None or isinstance(t, float) else t))

    return run


chunks_of = listed(chunk_text)


def sequence_ratio(a: str, b: str, least: float = 0.0) -> float:
    """2M / T of Ratcliff and Obershelp; 0 if a cheap bound already shows less than ``least``."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return 0.0
    return m.ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def near_duplicates(items: list[dict], threshold: float = 0.9) -> list[dict]:
    """Greedy over ranked items: a fact whose text is closer than ``threshold`` to a kept fact replaces it if its
    confidence is higher, and goes otherwise. Other kinds stay; a threshold of 0 switches it off."""
    kept: list[dict] = []
    for item in items:
        twin = next((k for k in kept if k["kind"] == "fact" and sequence_ratio(k["text"] or "", item["text"] or "", threshold) > threshold), None) if threshold > 0 and item["kind"] == "fact" else None
        if twin is None:
            kept.append(item)
        elif (item.get("confidence") or 0) > (twin.get("confidence") or 0):
            kept[kept.index(twin)] = item
    return kept


def collapse_near_facts(items: DataFrame, key: str, threshold: float = 0.9, most: int = 64) -> DataFrame:
    """R9 over the first ``most`` ranked items (key, rank, kind, text, confidence) of each question; later ones pass as they are."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        return pa.Table.from_pylist(near_duplicates(rows, threshold), table.schema)

    return items.where(F.col("rank") <= most).groupBy(key).applyInArrow(run, items.schema).unionByName(items.where(F.col("rank") > most))


def slice_sessions(df: DataFrame, keys: list[str], order: list[str], text: str, header: str, node: str, budget: int = SLICE_TOKENS) -> DataFrame:
    """Whole messages of a session packed into slices of ``budget`` estimated tokens; a longer message is split, later
    parts marked as continued. (keys, slice, slice_id, members, content)."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", slice long, slice_id string, members array<{df.schema[node].dataType.simpleString()}>, content string"

    def run(table: pa.Table) -> pa.Table:
        import hashlib

        rows = table.sort_by([(o, "ascending") for o in order]).to_pylist()
        parts = []
        for r in rows:
            body, room = r[text] or "", max(1, budget * 4 - len(r[header] or "") - 24)
            for i in range(0, max(len(body), 1), room):
                parts.append((r, f"{r[header]} {'(continued) ' if i else ''}{body[i : i + room]}"))
        out: dict[int, dict] = {}
        for (r, said), k in zip(parts, pack((max(1, len(p[1]) // 4) for p in parts), budget), strict=True):
            s = out.setdefault(k, {**{c: r[c] for c in keys}, "slice": k, "members": [], "content": []})
            s["content"].append(said)
            if r[node] not in s["members"]:
                s["members"].append(r[node])
        for s in out.values():
            s["content"] = "\n".join(s["content"])
            s["slice_id"] = hashlib.md5(json.dumps([[str(s[c]) for c in keys], s["slice"], [str(m) for m in s["members"]]]).encode()).hexdigest()
        return pa.Table.from_pylist(list(out.values())).select([*keys, "slice", "slice_id", "members", "content"])

    return df.groupBy(*keys).applyInArrow(run, schema)


# ---------------------------------------------------------------- stems

# The suffixes of Porter's algorithm (1980), by step.
STEP_2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """A word's letters as v (vowels) and c (consonants); y after a consonant is a vowel."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    """Whether a word ends consonant, vowel, consonant other than w, x and y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _swap(w: str, table: dict[str, str]) -> str:
    """The longest suffix of the table gives way if what stands before it has a measure."""
    end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
    return w[: -len(end)] + table[end] if end and _measure(w[: -len(end)]) > 0 else w


def stem(word: str) -> str:
    """Porter's stem of a word of small letters."""
    w = word
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        root = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
        if root is not None and "v" in _shape(root):
            w = root + "e" if root.endswith(("at", "bl", "iz")) or _measure(root) == 1 and _short(root) else root[:-1] if _doubled(root) and root[-1] not in "lsz" else root
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, dict(zip(STEP_2[::2], STEP_2[1::2], strict=True)))
    w = _swap(w, STEP_3)
    end = next((e for e in sorted(STEP_4, key=len, reverse=True) if w.endswith(e)), None)
    if end:
        root = w[: -len(end)]
        if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
            w = root
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(STRINGS)
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


# ---------------------------------------------------------------- payloads

# Wrappers of envelopes and the keys looked at first.
WRAPPERS = ("result", "message", "data", "payload", "body")
TEXT_KEYS = ("text", "content", "markdown", "markdownBody", "summary", "description", "title", "subject")
TIME_KEYS = ("timestamp", "createTime", "createdAt", "create_time", "time", "date", "receivedDateTime", "updateTime")


def unwrap(value, most: int = 8):
    """The payload inside known one-key wrappers, at most ``most`` layers."""
    for _ in range(most):
        inner = next((value[w] for w in WRAPPERS if isinstance(value, dict) and isinstance(value.get(w), dict) and len(value) <= 4), None)
        if inner is None:
            return value
        value = inner
    return value


def flatten_text(value, depth: int = 6, shortest: int = 8) -> list[str]:
    """Distinct texts of a payload in order: strings under known keys, and others of ``shortest`` characters or more."""
    out: dict[str, None] = {}

    def walk(v, known: bool, left: int) -> None:
        if isinstance(v, str):
            if v.strip() and (known or len(v.strip()) >= shortest):
                out.setdefault(v.strip())
        elif left > 0 and isinstance(v, dict):
            for k, x in v.items():
                walk(x, k in TEXT_KEYS, left - 1)
        elif left > 0 and isinstance(v, list):
            for x in v:
                walk(x, known, left - 1)

    walk(value, False, depth)
    return list(out)


def first_time(value, depth: int = 6):
    """The first value under a time key, depth first."""
    if depth < 0:
        return None
    if isinstance(value, dict):
        for k in TIME_KEYS:
            if isinstance(value.get(k), (int, float, str)) and value[k] not in ("", 0):
                return value[k]
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if (t := first_time(x, depth - 1)) is not None:
            return t
    return None


@F.pandas_udf(T.StructType([T.StructField("texts", STRINGS), T.StructField("time", T.StringType()), T.StructField("title", T.StringType())]))
def read_payload(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        try:
            v = unwrap(json.loads(r)) if isinstance(r, str) else None
        except ValueError:
            v = None
        t = first_time(v) if v is not None else None
        title = next((str(v[k]) for k in ("title", "subject", "name") if isinstance(v, dict) and v.get(k)), None)
        rows.append((flatten_text(v), None if t is None else str(t), title))
    return pd.DataFrame(rows, columns=["texts", "time", "title"])


@F.pandas_udf(T.StructType([T.StructField("subject", T.StringType()), T.StructField("object", T.StringType()), T.StructField("involved", STRINGS)]))
def participants(raw: pd.Series) -> pd.DataFrame:
    """Subject and object of a fact given as JSON. Names are strings: of a list the first one counts and the
    others are involved; any other value is none. ``involved`` is taken from a list only."""

    def one(v):
        if isinstance(v, str):
            return v, []
        names = [x for x in v if isinstance(x, str) and x.strip()] if isinstance(v, list) else []
        return (names[0] if names else None), names[1:]

    rows = []
    for r in raw:
        try:
            v = json.loads(r) if isinstance(r, str) else {}
        except ValueError:
            v = {}
        v = v if isinstance(v, dict) else {}
        (s, more), (o, rest) = one(v.get("subject")), one(v.get("object"))
        named = [x for x in v["involved"] if isinstance(x, str)] if isinstance(v.get("involved"), list) else []
        for x in (*more, *rest):
            if x not in named:
                named.append(x)
        rows.append((s, o, named))
    return pd.DataFrame(rows, columns=["subject", "object", "involved"])


# ---------------------------------------------------------------- facets


def merge_facet(old: dict | None, new: dict, most_evidence: int = 50) -> dict:
    """One step of the facet fold. What the user wrote wins; numbers average by evidence; of lists the union stays and
    confidence rises if they agree; differing scalars are a conflict that lowers confidence unless the new one is surer."""
    if old is None:
        return {**new, "revision": 1}
    if old["source"] == "user" and new["source"] != "user":
        return old
    evidence = list(dict.fromkeys([*old["evidence"], *new["evidence"]]))[-most_evidence:]
    a, b = json.loads(old["value"]), json.loads(new["value"])
    confidence = max(old["confidence"], new["confidence"])
    if new["source"] == "user":
        value, confidence = b, 1.0
    elif isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        na, nb = max(1, len(old["evidence"])), max(1, len(new["evidence"]))
        value = (a * na + b * nb) / (na + nb)
    elif isinstance(a, list) and isinstance(b, list):
        value = a + [x for x in b if x not in a]
        confidence = min(1.0, confidence + (0.1 if value == a else 0.05))
    elif a == b:
        value, confidence = a, min(1.0, confidence + 0.1)
    else:
        value, confidence = (b, new["confidence"]) if new["confidence"] > old["confidence"] else (a, max(0.0, old["confidence"] - 0.1))
    said = json.dumps(value, ensure_ascii=False, sort_keys=True)
    changed = said != json.dumps(a, ensure_ascii=False, sort_keys=True)
    return {**old, "value": said, "confidence": confidence, "evidence": evidence, "source": new["source"], "revision": old["revision"] + changed}


def fold_facets(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """D1 over all rows (keys, value, confidence, evidence, source, order) of each facet key."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", value string, confidence double, evidence array<string>, source string, revision int"

    def run(table: pa.Table) -> pa.Table:
        state = None
        for row in table.sort_by(order).to_pylist():
            state = merge_facet(state, row)
        names = [*keys, "value", "confidence", "evidence", "source", "revision"]
        return pa.Table.from_pylist([{k: state[k] for k in names}]).cast(pa.schema([table.schema.field(k) for k in keys] + [("value", pa.string()), ("confidence", pa.float64()), ("evidence", pa.list_(pa.string())), ("source", pa.string()), ("revision", pa.int32())]))

    return df.groupBy(*keys).applyInArrow(run, schema)


def explode_chunks(df: DataFrame, text: Column | str, *keep: str, chunker: Callable[[str | None], list[str]] = chunk_text) -> DataFrame:
    """One row for each chunk, with its ordinal."""
    column = F.col(text) if isinstance(text, str) else text
    return df.select(*keep, F.posexplode(listed(chunker)(column)).alias("ordinal", "chunk"))
