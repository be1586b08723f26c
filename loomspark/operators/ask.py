"""Composite questions: strategies by name, checkpointed steps, and ``ask``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import python as py, text as tx
from . import graph as gr, retrieval as rt
from .checkpoints import cut
from .textindex import TextIndex

#: Chunking policies, text to chunks.
CHUNKERS: dict[str, Callable[[str | None], list[str]]] = {
    "document": lambda t: py.chunk_text(t), "part": lambda t: py.chunk_text(t, py.PART_CHARS, headings=False), "fixed": lambda t: [t[i : i + 1200] for i in range(0, max(1, len(t) - 200), 1000)] if t else [], "tokens": lambda t: py.merge_tokens(t),
}
#: Extraction policies, a text column to facts; the default is a rule, a model is a callable of the same shape.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {"rules": tx.rule_fact}
#: Similarity strategies, (vectors, threshold, per row) to pairs.
SIMILARITY: dict[str, Callable[..., DataFrame]] = {"all_pairs": rt.similar_pairs}


def strategy(registry: dict, name: str):
    """A registered strategy; an error names the known ones."""
    if name not in registry:
        raise KeyError(f"unknown strategy {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]


def incremental_similarity(vectors: DataFrame, new_ids: DataFrame, least: float, per_row: int, vec: str = "vec_id") -> DataFrame:
    """Pairs with a new row. Equal to the pairs of all rows that have a new end."""
    pairs = rt.similar_pairs(vectors, least, per_row, vec)
    n = new_ids.select(F.col(vec).alias("n")).distinct()
    with_a = pairs.join(n, pairs["a"] == n["n"], "left_semi")
    return with_a.unionByName(pairs.join(n, pairs["b"] == n["n"], "left_semi")).distinct()


@dataclass
class Intent:
    """What a question is about; a model's rewrite or the caller's own."""

    entities: list[str] = field(default_factory=list)
    entity_types: list[str] = field(default_factory=list)
    fact_types: list[str] = field(default_factory=list)

    def clipped(self) -> Intent:
        return Intent(self.entities[:10], self.entity_types[:3], self.fact_types[:3])


def lexical_intent(question: str) -> Intent:
    """The default rewrite without a model: distinct words of four letters or more."""
    return Intent(list(dict.fromkeys(w for w in question.split() if len(w) >= 4))).clipped()


@dataclass
class Graph:
    """The frames that a question runs on: chunks (chunk, text), entities (entity, name, entity_type, mentions), facts (fact, text,
    fact_type, confidence, chunk), mentions (entity, chunk), about (fact, entity). Stored with a graph and read by every
    question: ``ranks`` (entity, rank) and the indexes of both texts; what is absent is made for the first question. Chunks and facts
    have whole numbers as ids."""

    chunks: DataFrame
    entities: DataFrame
    facts: DataFrame
    mentions: DataFrame
    about: DataFrame
    ranks: DataFrame | None = None
    indexes: dict[str, TextIndex] = field(default_factory=dict)

    def pagerank(self, most: int = 20) -> DataFrame:
        if self.ranks is None:
            links = self.about.join(self.facts.select("fact", "confidence"), "fact")
            edges = gr.co_participation(links, "fact", "entity", F.col("confidence")).select("a", "b", "weight")
            self.ranks = cut(gr.pagerank(edges, most=most).select(F.col("node").alias("entity"), "rank"))
        return self.ranks

    def index(self, kind: str) -> TextIndex:
        if kind not in self.indexes:
            self.indexes[kind] = TextIndex.build({"chunk": self.chunks, "fact": self.facts}[kind], kind, tx.tokenize("text"))
        return self.indexes[kind]


def lexical_list(g: Graph, question: str, kind: str, k: int) -> DataFrame:
    """(list, query, item, rank, kind): the ``k`` best chunks or facts by BM25 over the question's tokens."""
    spark = g.chunks.sparkSession
    asked = spark.createDataFrame([(0, question)], "query long, text string").select("query", F.explode(F.array_distinct(tx.tokenize("text"))).alias("token"))
    hits = g.index(kind).search(asked, k, "query")
    return rt.ranked(hits, f"bm25_{kind}", "query", "doc", [F.desc("score"), F.col("doc")], k).select("list", "query", F.col("doc").cast("string").alias("item"), "rank", F.lit(kind).alias("kind"))


def matched_entities(g: Graph, intent: Intent) -> DataFrame:
    """(entity, sim, entity_type): entities of the name, or else with the name in theirs."""
    words = g.entities.sparkSession.createDataFrame([(w,) for w in intent.entities] or [("",)], "keyword string").where("keyword <> ''")
    scored = g.entities.join(rt.checked_broadcast(words, 1_000), F.lower("name") == F.lower("keyword")).select("keyword", "entity", F.lit(1.0).alias("sim"))
    return cut(rt.link_entities(scored, g.entities, words).join(g.entities.select("entity", "entity_type"), "entity"))


def expansion_lists(g: Graph, matched: DataFrame, intent: Intent, k: int = 20) -> DataFrame:
    """(list, query, item, rank, kind): the ``k`` best chunks and facts around matched entities."""
    near = rt.checked_broadcast(matched.select("entity"), 100_000)
    about = g.about.join(near, "entity", "left_semi").join(g.facts.select("fact", "fact_type", "confidence"), "fact")
    grown = rt.expand(matched, g.mentions.join(near, "entity", "left_semi"), about, g.pagerank(), intent.entity_types, intent.fact_types)
    grown = cut(grown.select(F.lit(0).cast("long").alias("query"), F.col("item").cast("string").alias("item"), "kind", "score"))
    lists = [rt.ranked(grown.where(F.col("kind") == kind), f"graph_{kind}", "query", "item", [F.desc("score"), F.col("item")], k).withColumn("kind", F.lit(kind)) for kind in ("chunk", "fact")]
    return lists[0].unionByName(lists[1])


def ask(spark: SparkSession, g: Graph, question: str, intent: Intent | None = None, top: int = 30, scorer=None, answer: Callable[[str], str] | None = None, radius: int = 0) -> dict:
    """Ranked items, with ``radius`` the walk around matched entities, confidence and, with a model, an answer.

    Lists: BM25 over chunks and over facts, and the expansion of matched entities; fused by
    reciprocal ranks, exact duplicates collapsed, near facts collapsed, re-ranked.
    """
    intent = (intent or lexical_intent(question)).clipped()
    matched, rank = matched_entities(g, intent), g.pagerank()
    lists = lexical_list(g, question, "chunk", 20).unionByName(lexical_list(g, question, "fact", 10)).unionByName(expansion_lists(g, matched, intent))
    fused = cut(rt.top_k(rt.rrf(lists, ["query", "kind"], "item"), "query", [F.desc("score"), F.desc("n_lists"), F.col("kind"), F.col("item")], 64))
    texts = g.chunks.select(F.col("chunk").cast("string").alias("item"), F.lit("chunk").alias("kind"), "text", F.lit(None).cast("double").alias("confidence")).unionByName(g.facts.select(F.col("fact").cast("string").alias("item"), F.lit("fact").alias("kind"), "text", "confidence"))
    items = rt.collapse_duplicates(texts.join(F.broadcast(fused), ["item", "kind"]), ["query"], "item", "text", "kind")
    kept = rt.rerank(py.collapse_near_facts(items, "query"), scorer, top)
    walk = None
    if radius:  # nodes are named by kind and id: a fact and an entity may have the same number
        node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        adj = gr.adjacency(g.about.select(node("fact", "fact").alias("fact"), node("entity", "entity").alias("entity")), "fact", "entity")
        walk = gr.walk(adj, matched.select(node("entity", "entity").alias("node"), F.col("sim").alias("score")).limit(6), rank.select(node("entity", "entity").alias("node"), F.col("rank").alias("importance")), radius=radius)
    out = {"intent": intent, "items": kept, "walk": walk, "confidence": rt.confidence(kept), "prompt": prompt(kept, question)}
    if answer is not None:
        out["answer"] = answer(out["prompt"].first()["prompt"])
    return out


def prompt(items: DataFrame, question: str, facts: int = 10, chunks: int = 50) -> DataFrame:
    """One row with the prompt: facts and chunks in rank order, numbered, texts cut to 200."""
    numbered = rt.top_k(items, "kind", [F.col("rank")], chunks, "n").where((F.col("kind") != "fact") | (F.col("n") <= facts))
    line = F.format_string("%d. %s", "n", F.substring("text", 1, 200))
    body = numbered.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "body")), lambda a, b: F.when(a["kind"] > b["kind"], -1).when(a["kind"] < b["kind"], 1).otherwise(0)), lambda x: F.concat(F.lit("## "), x["kind"], F.lit("s\n"), x["body"])), "\n\n")
    return body.agg(F.concat(F.lit(f"Question: {question}\n\n"), said).alias("prompt"))


class Steps:
    """Named steps with done marks in a Parquet table; changed parameters or a changed source start anew."""

    def __init__(self, spark: SparkSession, folder: str, fingerprint: str):
        self.spark, self.folder, self.fingerprint = spark, folder, fingerprint

    def done(self) -> set[str]:
        try:
            marks = self.spark.read.schema("step string, fingerprint string").parquet(self.folder)
            return {r.step for r in marks.where(F.col("fingerprint") == self.fingerprint).select("step").distinct().collect()}  # one row a step
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return set()
            raise

    def run(self, steps: list[tuple[str, Callable[[], None]]]) -> list[str]:
        ran, known = [], self.done()
        for name, work in steps:
            if name not in known:
                work()
                self.spark.createDataFrame([(name, self.fingerprint)], "step string, fingerprint string").write.mode("append").parquet(self.folder)
                ran.append(name)
        return ran


def recovery(error: str) -> str:
    """What to do about a failure: retry, wait, fix or resume."""
    low = error.lower()
    if any(w in low for w in ("timeout", "connection", "temporarily")):
        return "retry"
    if any(w in low for w in ("rate limit", "429", "quota")):
        return "wait"
    if any(w in low for w in ("schema", "permission", "not found", "invalid")):
        return "fix"
    return "resume"
