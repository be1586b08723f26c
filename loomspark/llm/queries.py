"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, decontam, lines, neardup, negatives, quality, secrets, sharding, simhash, spelling, substring, tokenids
from .common import documents

#: Small shards, about the size of a row group, so that tables of any size split to uneven depths.
SHARD_BYTES = 128 << 10


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_index(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_ids(documents(spark, sf_dir), SHARD_BYTES)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(documents(spark, sf_dir), size=50)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM d WHERE len(words) >= 50),
k AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS gram FROM g),
m AS (SELECT doc_id, pos, doc_id > min(doc_id) OVER (PARTITION BY gram) AS gone FROM k),
c AS (SELECT w.doc_id, w.word, w.pos, coalesce(bool_or(m.gone) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS 49 PRECEDING), false) AS gone
      FROM w LEFT JOIN m ON m.doc_id = w.doc_id AND m.pos = w.pos),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=2).drop("h", "cls")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(documents(spark, sf_dir), min_words=1, digest=True, near="grams")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(documents(spark, sf_dir))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(documents(spark, sf_dir), size=4, differ=4)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


#: CRC-32 from its polynomial, and pairs of one edit by what is left without one code point.
OP12_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hex FROM runs),
bytes AS (SELECT run, n, list_transform(range(1, length(hex), 2), lambda i: (instr('0123456789ABCDEF', hex[i]) - 1) * 16 + instr('0123456789ABCDEF', hex[i + 1]) - 1) AS b FROM coded),
crc AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) % 256) + 1])), 4294967295) AS h FROM bytes, tbl),
spelt AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM w)),
p AS MATERIALIZED (SELECT a.word AS x, b.word AS y FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON w.word = v.rest UNION SELECT w.word, v.word FROM v JOIN w ON w.word = v.rest),
f AS MATERIALIZED (SELECT w.word, w.n, count(p.y) AS n_near, arg_min(p.y, (-o.n, p.y)) AS best, max(o.n) AS best_n FROM w LEFT JOIN p ON p.x = w.word LEFT JOIN w o ON o.word = p.y GROUP BY w.word, w.n),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM f),
r(word, top, step) AS (SELECT word, word, 0 FROM g UNION ALL SELECT r.word, g.form, r.step + 1 FROM r JOIN g ON g.word = r.top WHERE g.form IS NOT NULL)
SELECT g.word, g.n, g.n_near, g.form, g.form_n, l.root FROM g JOIN (SELECT word, arg_max(top, step) AS root FROM r GROUP BY word) l ON l.word = g.word
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
      FROM (SELECT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_nearest": op9_nearest,
    "op10_bpe": op10_bpe,
    "op11_simhash": op11_simhash,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op3_sharding": sharding.oracle(SHARD_BYTES),
    "op5_substring_dedup": OP5_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
