"""Column and Arrow functions on literal values."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import python as py, text as tx, vectors as vx


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **values):
        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
        return row.select(column.alias("x")).first()["x"]

    return run


@pytest.mark.parametrize(("text", "want"), [
    ("", []), (None, []), ("修复bug了", ["修", "修复", "复", "bug", "了"]), ("好，的", ["好", "的"]), ("Deploy k8s-prod NOW", ["deploy", "k8s-prod", "now"]),
    ("沙箱", ["沙", "沙箱", "箱"]), ("a+b#c.d_e", ["a+b#c.d_e"]), ("が한", ["が", "が한", "한"]), ("  !? ", []),
])
def test_tokens(value, text, want):
    assert value(tx.tokenize(F.lit(text).cast("string"))) == want


def test_query_tiers(value):
    assert value(tx.query_tiers("t"), t="部署沙箱") == [["部", "部署", "署", "署沙", "沙", "沙箱", "箱"], ["部", "署", "沙", "箱"]]
    assert value(tx.query_tiers("t"), t="deploy") == [["deploy"]]
    assert value(tx.query_tiers("t"), t="!") == []
    assert value(tx.index_segment("t"), t="a b a") == "a b"
    assert value(tx.match_expression(F.array(F.lit('a"b'), F.lit("c")))) == '"a""b" AND "c"'
    with pytest.raises(Exception, match="at least one token"):
        value(tx.match_expression(F.array().cast("array<string>")))


def test_normal_forms(value):
    assert value(tx.normalize_query("t"), t="  ＡＢＣ中文abc  def　x ") == "abc 中文 abc def x"
    assert value(tx.normalize_query("t"), t="   ") == ""
    assert value(tx.dedup_hash("t"), t=" a \n b ") == value(tx.dedup_hash("t"), t="a b")
    assert value(tx.dedup_hash("t"), t="  ") is None
    assert value(tx.differs_only_by_punctuation("a", "b"), a="Foo-Bar!", b="foobar") is True
    assert value(tx.differs_only_by_punctuation("a", "b"), a="foobar", b="foobar") is False
    assert value(tx.normalize_answer("t"), t="The Answer, is a 42!") == "answer is 42"


def test_similarities(value):
    assert value(tx.edit_similarity("a", "b"), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert value(tx.edit_similarity("a", "b"), a="", b="x") == 0 and value(tx.edit_similarity("a", "b"), a="x", b="x") == 1
    assert value(tx.char_jaccard("a", "b"), a="abc", b="bcd") == pytest.approx(0.5)
    three, two = F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (2, 3, 9)))
    assert value(tx.structural_jaccard(three, two)) == 0 and value(tx.structural_jaccard(three, two, 2)) == pytest.approx(2 / 5)
    assert value(tx.conversation_overlap(three, two)) == pytest.approx(2 / 3)
    old, new = F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (3, 4, 5)))
    assert [round(value(tx.churn(old, new, d)), 4) for d in ("baseline", "current", "union", "larger")] == [0.75, 1.0, 0.6, 0.75]
    assert value(tx.facet_key("t"), t="b a c a") == "a b c"


@pytest.mark.parametrize("name", ["entity:ada", "", "中文", "x" * 300])
def test_uuid5(value, name):
    assert value(tx.uuid5("n"), n=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


@pytest.mark.parametrize(("raw", "want"), [
    ("1700000000", 1_700_000_000_000), ("1700000000000", 1_700_000_000_000), ("-5", 0), ("", 0), ("nonsense", 0), ("2024-01-01T00:00:00Z", 1_704_067_200_000), ("2024-01-01T08:00:00+08:00", 1_704_067_200_000),
    ("2024-01-01 00:00:00", 1_704_067_200_000), ("2024-01-01 00:00", 1_704_067_200_000), ("2024/01/01 00:00:00", 1_704_067_200_000),
])
def test_epoch(value, raw, want):
    assert value(tx.epoch_ms("v"), v=raw) == want


def test_time(value):
    assert value(tx.epoch_ms("v", 1e11), v="150000000000") == 150_000_000_000
    at = 1_704_067_200_000 + 20 * 3_600_000
    assert value(tx.dated("t", "ms"), t="x", ms=at) == "[2024-01-02] x"
    assert value(tx.dated("t", "ms"), t="[2020-01-01] x", ms=at) == "[2020-01-01] x"
    assert value(tx.dated("t", "ms"), t="x", ms=0) == "x"
    monday_nine = 1_704_067_200_000 + 9 * 3_600_000
    assert value(tx.in_work_hours("ms"), ms=monday_nine) is True
    assert value(tx.in_work_hours("ms"), ms=monday_nine - 1) is False
    assert value(tx.in_work_hours("ms"), ms=monday_nine + 5 * 86_400_000) is False


def test_json(value):
    assert value(tx.tolerant_json("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert value(tx.tolerant_json("t"), t='so {"a": {"b": 2}} done') == '{"a": {"b": 2}}'
    assert value(tx.tolerant_json("t"), t="none") is None
    assert [tuple(p) for p in value(tx.parse_points("t"), t='{"points":[{"text":"a","score":5},{"text":" ","score":5},{"text":"b","score":101},{"text":"c","score":true},{"text":"d","score":1.5}]}')] == [("a", 5)]
    assert value(tx.parse_points("t"), t="x") == []
    ids = F.array(*map(F.lit, "abcdefg"))
    assert value(tx.with_citations("t", ids), t="Said. [x, y]") == "Said. [a, b, c, d, e, +more]"
    assert value(tx.with_citations("t", F.array().cast("array<string>")), t="Said.") == "Said."


def test_rules(value):
    assert tuple(value(tx.rule_fact("t"), t="我们决定采用新的方案上线")) == ("DECISION", "我们决定采用新的方案上线", 0.8)
    assert value(tx.rule_fact("t"), t="张三负责后端开发工作")["fact_type"] == "DELEGATE"
    assert value(tx.rule_fact("t"), t="短") is None and value(tx.rule_fact("t"), t="[图片消息] 决定采用方案") is None
    found = value(tx.rule_entities("t", {"Kafka": "System"}), t="@小明 看看 OrderService 和 【灯塔计划】 Kafka @小明")
    assert [tuple(e) for e in found] == [("Kafka", "System"), ("小明", "Person"), ("OrderService", "System"), ("灯塔计划", "Project")]
    for raw, clean in {"@ Ada, ": "Ada", "@all": None, "channel": None, "@全体": None, "C++": "C++", "x)": "x)", "lovelyenormoushandleofmine": "lovelyenormoushandleofmine", "lQ" + "a1" * 9: None, "aB3" * 7: None, "@": None}.items():
        assert value(tx.clean_mention("t"), t=raw) == clean, raw
    assert value(tx.entity_type("t"), t=" tool") == "System" and value(tx.fact_type("t"), t="todo") == "ACTION_ITEM"
    assert value(tx.media_ids("t"), t="(mediaId=abc) (mediaId=abc) fileId=9") == ["abc", "9"]
    assert value(tx.mentions_self("t", ["Ada"]), t="hi @Ada(x)") is True
    assert len(value(tx.split_messages("t"), t="[1] a: x\ny\n[2] b: z")) == 2
    assert tuple(value(tx.header_body(F.col("t")), t="[1] a: x")) == ("[1] a:", "x")


def test_vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((20, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(20, [0.0] * 8)], "i int, v array<float>")
    for r in df.select("i", vx.quantize_int8("v").alias("q"), vx.decode_float32(vx.encode_float32("v")).alias("w"), "v").collect():
        unit = np.array(r.v, float)
        unit = unit / np.linalg.norm(unit) if unit.any() else unit
        scale = np.abs(unit).max() / 127 if unit.any() else 1.0
        assert r.q.scale == pytest.approx(scale) and r.q.q == np.clip(np.floor(unit / scale + 0.5), -127, 127).astype(int).tolist()
        assert r.w == r.v
    a = df.where("i < 10").select(vx.quantize_int8("v").alias("a"), "v")
    got = a.select(vx.cosine_int8(F.col("a"), F.col("a")).alias("c"), vx.cosine("v", "v").alias("d")).collect()
    assert all(abs(r.c - 1) < 0.02 and abs(r.d - 1) < 1e-9 for r in got)


def test_packing():
    assert py.pack([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]
    assert py.pack([5, 5, 20, 5], 10, drop_oversized=True) == [0, 0, None, 1]


def test_chunks():
    rng = random.Random(2)
    text = "\n\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 80))) + "." for _ in range(40))
    out = py.chunk_text(text, 300)
    assert all(len(c) <= 300 for c in out) and "".join("".join(out).split()) == "".join(text.split())
    assert [c.split("\n")[0] for c in py.chunk_text("# A\nx\n# B\ny", 300)] == ["# A", "# B"]
    assert py.chunk_text("z" * 1000, 300) == ["z" * 300] * 3 + ["z" * 100]
    assert py.chunk_text(None) == py.chunk_text("  ") == []
    assert py.chunk_text("a" * 10 + "\n" + "b" * 10, 12, overlap=3)[1] == "aa\n" + "b" * 10
    assert [c.split("\n")[0] for c in py.chunk_text("# A\nx\n### B\ny\n##\tC\nz", 14)] == ["# A", "##\tC"]
    assert py.merge_tokens("one##two", 100, "`##`") == ["one", "two"]
    assert len(py.merge_tokens("aaaa. " * 50, 20, ".")) > 1


def test_near_duplicate_facts():
    a = {"kind": "fact", "text": "the plan moves to monday", "confidence": 0.5, "rank": 1}
    b = {"kind": "fact", "text": "the plan moves to mondays", "confidence": 0.9, "rank": 2}
    c = {"kind": "chunk", "text": "the plan moves to monday", "confidence": None, "rank": 3}
    assert py.near_duplicates([a, b, c]) == [b, c]
    assert py.near_duplicates([a, {**b, "confidence": 0.5}]) == [a]
    assert py.near_duplicates([a, b], 0) == [a, b]


def test_payloads(spark):
    assert py.unwrap({"result": {"data": {"x": 1}}}) == {"x": 1}
    assert py.flatten_text({"title": "T", "n": 5, "items": [{"text": "hello"}, "short", "a longer string", {"text": "hello"}]}) == ["T", "hello", "a longer string"]
    assert py.first_time({"a": {"createTime": "2024"}}) == "2024"
    df = spark.createDataFrame([('{"result": {"title": "A", "text": "body", "createTime": 5}}',), ("bad",), (None,)], "r string")
    got = [tuple(r.p) for r in df.select(py.read_payload("r").alias("p")).collect()]
    assert got == [(["A", "body"], "5", "A"), ([], None, None), ([], None, None)]
    one = spark.createDataFrame([('{"subject": ["A", "B"], "object": "C", "involved": ["D"]}',), ('{"subject": true}',), ('{"subject": [3, " ", "A", "B"], "object": 4, "involved": "E"}',), ('{"involved": ["D", 5, "D"], "object": ["X", "D"]}',)], "r string")
    assert [tuple(r.p) for r in one.select(py.participants("r").alias("p")).collect()] == [("A", "C", ["D", "B"]), (None, None, []), ("A", None, ["B"]), (None, "X", ["D", "D"])]


def test_facets():
    f = lambda v, c, src="llm", e=("1",): {"value": v, "confidence": c, "evidence": list(e), "source": src}
    one = py.merge_facet(None, f("4", 0.5))
    assert one["revision"] == 1
    assert py.merge_facet(one, f("10", 0.5, e=("2", "3")))["value"] == "8.0"
    assert py.merge_facet({**one, "source": "user"}, f("10", 0.9))["value"] == "4"
    assert py.merge_facet(one, f('"x"', 0.1, "user"))["confidence"] == 1.0
    lists = py.merge_facet(py.merge_facet(None, f('["a"]', 0.5)), f('["b"]', 0.5))
    assert lists["value"] == '["a", "b"]' and lists["revision"] == 2


# Examples that the algorithm's publication gives.
PORTER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic vileli vile vietnamization vietnam operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PORTER[::2], PORTER[1::2], strict=True)))
def test_stems(word, want):
    assert py.stem(word) == want
