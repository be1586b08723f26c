"""The line field, and the pipeline end to end."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import quality as q


def test_lines_of_texts():
    texts = ["a b\nc", None, "", "\n", "x\n", "", "UP !!\nUP !!"]
    x, size, first = q.line_features(pa.array(texts, pa.string()))
    counts = np.diff(np.r_[first, len(x)]).tolist()
    assert counts[0] == 2 and counts[1] == 1 and counts[2] == 1 and counts[6] == 2 and min(counts) >= 1
    assert x[first[6] + 1][10] == 1 and x[first[6]][10] == 0  # the second twin repeats


def brute_marginals(score, move):
    n = len(score)
    weight = {}
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        weight[k] = np.exp(sum(s for s, v in zip(score, y, strict=True) if v) + sum(move[a][b] for a, b in zip(y, y[1:], strict=False)))
    z = sum(weight.values())
    return [sum(w for k, w in weight.items() if (k >> i) & 1) / z for i in range(n)], np.log(z)


def test_forward_backward():
    rng = np.random.default_rng(1)
    move = rng.standard_normal((2, 2))
    score = rng.standard_normal((4, 6))
    size = np.array([6, 3, 1, 5])
    filled = np.arange(6) < size[:, None]
    p, moves, z = q.forward_backward(score * filled, filled, move)
    total = 0
    for i, n in enumerate(size):
        want, log_z = brute_marginals(score[i, :n].tolist(), move.tolist())
        assert np.allclose(p[i, :n], want) and np.isclose(z[i], log_z)
        total += n - 1
    assert np.isclose(moves.sum(), total)


def training():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdeiorst"), rng.integers(2, 7)))
    texts, labels = [], []
    for i in range(160):
        good = i % 3 > 0
        line = lambda: " ".join(word() for _ in range(rng.integers(3, 12)))  # noqa: E731, B023
        junk = lambda: " ".join(word().upper() + "!!" for _ in range(rng.integers(3, 12)))  # noqa: E731, B023
        texts.append("\n".join(line() if good or rng.random() < 0.2 else junk() for _ in range(rng.integers(1, 9))))
        labels.append(int(good))
    return texts, np.array(labels)


def test_field_learns_and_is_batch_free():
    texts, labels = training()
    field = q.fit(texts[:100], labels[:100])
    s = field.score(pa.array(texts[100:]))
    assert ((s >= 0.3) == labels[100:]).mean() >= 0.9
    alone = np.array([field.score(pa.array([t]))[0] for t in texts[100:]])
    assert np.allclose(s, alone)
    odd = field.score(pa.array([None, "", "x " * 50_000, "a\n" * 3000], pa.string()))
    assert ((odd >= 0) & (odd <= 1)).all()


def test_training_documents_of_many_lines():
    """Documents of over MAX_LINES lines are learnt from too, also where there are no others."""
    good = ["\n".join(f"the quick brown fox jumps over line {i} of a calm text." for i in range(q.MAX_LINES + n)) for n in range(1, 12)]
    bad = ["\n".join("!!! $$$ 1234 %%%" for _ in range(2 * q.MAX_LINES + n)) for n in range(1, 12)]
    field = q.fit([*good, *bad], np.r_[np.ones(11), np.zeros(11)])
    score = field.score(pa.array([*good, *bad, None, ""], pa.string()))
    assert np.isfinite(score).all() and score[:11].min() > 0.5 > score[11:22].max()


def test_scores(frame, spark):
    texts, labels = training()
    docs = frame([*texts, None, "", (None, "null id"), (3, texts[3])])
    known = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(labels)] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_scores(docs, known).collect()
    assert len(got) == docs.count()
    import zlib

    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < len(labels)]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.85
    kept = q.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in q.quality_scores(docs, known.limit(0)).collect()} == {1.0}
    assert q.quality_scores(frame([]), known).count() == 0


def test_pipeline(spark, frame, corpus, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts, labels = training()
    docs = frame([*texts, *[t for t in corpus if not isinstance(t, tuple)]])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = texts[1][:80]
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append(now.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert now.where(F.col("doc_id") == 1).count() == 0
    assert sorted(map(repr, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, now.collect()))
