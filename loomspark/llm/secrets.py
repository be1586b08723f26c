"""Secret scan (operator 4): fixed patterns, and windows of high Shannon entropy.

Candidate strings (runs of key-like characters) are split into a character class
(hex, upper or lower alphanumeric, base64). A window slides over each; its entropy
follows from incremental counts: one character in, one out, changes two terms of
the sum of ``c * log2(c)``. Windows over the class's bound merge into spans. Names
of files and hosts, words, identifiers of public kinds (UUIDs, dates, plain
numbers) are on the allow list; of a candidate that base spans touch, only the rest is looked at.

Defined results: null texts are empty; positions are code points, ends exclusive;
repeated rows get the same result each; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base patterns and the lengths they must reach.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex", "entropy")

#: A cheap sign that ASSIGN may match.
HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Class: its characters, and bits a character that a window must reach.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+"), 2.9), ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.5), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7))
ALLOWED = re.compile(r"""[A-Za-z_-]+|[0-9_+/=-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:/?[a-z0-9_-]{1,14}/)+[a-z0-9_-]{0,14}|\d{4}-\d\d-\d\d[T_-](?:[A-Za-z_-]*|[0-9Z_+-]*)""")
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropy_spans(text: str, start: int) -> list[tuple[int, int]]:
    """Spans (shifted by ``start``) of one candidate whose windows reach the bound of its class."""
    if ALLOWED.fullmatch(text):
        return []
    bound = next(b for _, chars, b in CLASSES if chars.fullmatch(text))
    limit = (math.log2(WINDOW) - bound) * WINDOW  # of the sum of c log2 c
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    digits = letters = 0
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += _TERM[c + 1] - _TERM[c]
        counts[ch] = c + 1
        digits += ch.isdigit()
        letters += ch.isalpha()
        if i >= WINDOW:
            old = text[i - WINDOW]
            c = counts[old]
            total += _TERM[c - 1] - _TERM[c]
            counts[old] = c - 1
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= WINDOW - 1 and total <= limit and digits >= 2 and letters >= 2:
            begin, end = start + i + 1 - WINDOW, start + i + 1
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((begin, end))
    return spans


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, ascending; kinds are numbered as in KINDS."""
    if not text:
        return []
    found = []
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, at = sorted((s, e) for s, _, e in found), 0
    for m in CANDIDATE.finditer(text):  # both ascend: one sweep
        begin, end = m.span()
        while begin < end:
            while at < len(base) and base[at][1] <= begin:
                at += 1
            until = min(end, max(begin, base[at][0])) if at < len(base) else end
            if until - begin >= WINDOW:  # what no base span covers
                found += [(s, 3, e) for s, e in entropy_spans(text[begin:until], begin)]
            begin = max(until, base[at][1]) if at < len(base) and base[at][0] < end else end
    return sorted(found)


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)."""
    longs = ("n_assign", "n_access", "n_hex", "n_entropy")

    def run(batches):
        for batch in batches:
            spans = [scan(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
            base = [hashlib.sha256(_said(x for x in s if x[1] < 3).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array(map(_said, spans), pa.string())], ["doc_id", *longs, "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", base_sha256 string, spans string")
