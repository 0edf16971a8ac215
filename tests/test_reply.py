import pytest
from pyspark.sql import functions as F

from diglot.functions import plain, reply

CASES = [
    ("1. 甲\n2. 乙", None, {1: "甲", 2: "乙"}),
    ("1、甲\n2）乙\n3) 丙\n4．丁\n5：戊", None, {1: "甲", 2: "乙", 3: "丙", 4: "丁", 5: "戊"}),
    ("**1.** 甲\n**2.** 乙", None, {1: "甲", 2: "乙"}),
    ("- 1. 甲\n• 2. 乙", None, {1: "甲", 2: "乙"}),
    ("第1段：甲\n第 2 段：乙", None, {1: "甲", 2: "乙"}),
    ("1: a\n2: b", None, {1: "a", 2: "b"}),
    ("1. 甲\n继续\n2. 乙", None, {1: "甲 继续", 2: "乙"}),
    ("1. 甲\n1. 子\n2. 乙", None, {1: "甲 1. 子", 2: "乙"}),
    ("1. 甲\n2. 乙\n1. 重来", None, {1: "甲", 2: "乙 1. 重来"}),
    ("1. 甲\n7. 子项", 2, {1: "甲 7. 子项"}),
    ("前言\n1. 甲", None, {1: "甲"}),
    ("1. 甲\n2023. 年份", None, {1: "甲 2023. 年份"}),
    ("1. 比例\n1:2 是内容", None, {1: "比例 1:2 是内容"}),
    ('1. "引文"\n2. “引文”', None, {1: "引文", 2: "引文"}),
    ("什么都没有", None, {}),
    ("", None, {}),
    (None, None, {}),
]


@pytest.mark.parametrize(("raw", "expect", "want"), CASES)
def test_items(spark, raw, expect, want):
    assert plain.reply_items(raw, expect) == want
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(reply.items("r", None if expect is None else F.lit(expect)).alias("x")).first().x == want


def test_single(spark):
    df = spark.createDataFrame([(' "你好\n 世界" ',), (None,)], "r string")
    assert [r.x for r in df.select(reply.single("r").alias("x")).collect()] == ["你好 世界", None]


def test_a_lone_quote_stays(spark):
    df = spark.createDataFrame([('1. 译文：token = "\n2. “引文”\n3. "甲" 乙',)], "r string")
    want = {1: '译文：token = "', 2: "引文", 3: '"甲" 乙'}
    assert df.select(reply.items("r", F.lit(3), reply.unwrapped).alias("x")).first().x == want
    assert plain.reply_items(df.first().r, 3, plain.unwrapped) == want
