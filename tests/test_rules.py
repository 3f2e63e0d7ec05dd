"""Text rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules as R


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("e", "s", "level"), [("你好,世界", "你好，世界", "NORMALIZED"), ("你好", "你好世界", "EXACT"), ("你好世界XYZ", "你好世界", "NEAR"), ("甲乙丙丁", "你好世界", "UNSUPPORTED"), ("", "x", "UNSUPPORTED"), (None, "x", "UNSUPPORTED")])
def test_evidence(spark, e, s, level):
    df = spark.createDataFrame([(e, s)], "e string, s string")
    assert df.select(R.evidence_level("e", "s").alias("x")).first()["x"] == level


@pytest.mark.parametrize(("a", "b", "said", "sure"), [("师父", "小姐", "BLOCK", 0.9), ("赵云", "钱云", "BLOCK", 0.95), ("宋江", "宋江", "MERGE", 0.99), ("林冲", "林充", "MERGE", 0.7), ("欧阳修道", "欧阳", "UNCERTAIN", 0.4), ("欧阳先生", "欧阳", "MERGE", 0.6), ("欧阳修三", "欧阳修四", "BLOCK", 0.85), ("宋江", "燕青", "UNCERTAIN", 0.2)])
def test_alias(spark, a, b, said, sure):
    d, c = R.alias_decision("a", "b")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(d.alias("d"), c.alias("c")).first()
    assert (row.d, row.c) == (said, sure)


@pytest.mark.parametrize(("n", "best", "entity", "retries", "want"), [(0, None, None, 0, "retry_broader"), (0, None, None, 1, "fail_insufficient"), (3, 0.5, None, 0, "pass"), (3, 0.3, "x", 0, "retry_entity"), (3, 0.3, None, 0, "retry_broader"), (3, 0.3, None, 1, "fail_insufficient"), (2, 0.9, "x", 0, "retry_entity"), (2, 0.9, None, 0, "retry_broader")])
def test_gate(spark, n, best, entity, retries, want):
    df = spark.createDataFrame([(n, best, entity, retries)], "n int, best double, entity string, retries int")
    assert df.select(R.gate("n", "best", "entity", "retries").alias("x")).first()["x"] == want


def test_polish(spark):
    raw = '宋江。。<cite type="chunk" id="1">x</cite> [chunk_12]，\n\n\n\nend。'
    got = one(spark, R.polish("t"), t=raw)
    assert "cite" not in got and "chunk_12" not in got and "。。" not in got and not got.endswith("。")


def test_classical(spark):
    assert one(spark, R.is_classical("t"), t="之乎者也" * 20) is True
    assert one(spark, R.is_classical("t"), t="的了着过" * 20) is False
    assert one(spark, R.is_classical("t"), t="之乎者也") is False


def test_keywords(spark):
    assert one(spark, R.ngram_keywords("t"), t="宋江与林冲") == sorted(["宋江", "江与", "与林", "林冲", "宋江与", "江与林", "与林冲", "宋江与林", "江与林冲"], key=lambda g: (len(g), g))


def test_citations(spark):
    got = one(spark, R.citations("t"), t='a<cite type="chunk" id="3">b</cite>c<cite type="entity">d</cite>')
    assert [tuple(x) for x in got] == [("chunk", 3, "b"), ("entity", 0, "d")]


def test_hint_lines_and_json(spark):
    text = "# note\n宋江|character|及时雨, 公明\nbad"
    got = one(spark, R.hint_entities("t"), t=text)
    assert [(x.name, x.type, list(x.aliases)) for x in got] == [("宋江", "character", ["及时雨", "公明"])]
    got = one(spark, R.hint_entities("t"), t='{"characters": [{"name": "林冲", "type": "character"}]}')
    assert got[0].name == "林冲"


def test_types(spark):
    assert one(spark, R.relation_type("t"), t=" 师父 ") == "师徒"
    assert one(spark, R.relation_type("t"), t="父子") == "父子"
    assert one(spark, R.relation_type("t"), t="zzz") == "未知"
    assert one(spark, R.event_type("t"), t="登基大典") == "登基"
    assert one(spark, R.event_type("t"), t="zzz") == "zzz"
