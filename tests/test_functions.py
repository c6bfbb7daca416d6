from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jadwal.functions import fuzzy, text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(("given", "want"), [("٢/أ", "2/ا"), ("الأَحَد", "الاحد"), ("ثانيةٌ", "ثانيه"), (None, ""), ("a\n\n  b ", "a\nb"), ("ﻻ", "لا")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize_arabic, given) == want


def test_digits(spark):
    assert one(spark, text.to_arabic_digits, "27") == "٢٧"


@pytest.mark.parametrize(("given", "want"), [("at 7:05", 425), ("1:30", 810), ("1:30 am", 90), ("12:10 pm", 730), ("25:00", None), ("none", None), (None, None)])
def test_first_time(spark, given, want):
    assert one(spark, text.first_time, given) == want


@pytest.mark.parametrize(("given", "want"), [("8:05", 485), ("24:00", None), ("8:5", None), (None, None)])
def test_parse_time(spark, given, want):
    assert one(spark, text.parse_time, given) == want


def test_tokens(spark):
    assert one(spark, text.tokens, "a/b-.c: ") == ["a", "b", "c"]


def test_class_and_course_keys(spark):
    assert one(spark, lambda c: text.class_key(text.fold(c)), "٢ - أ") == "2/ا"
    assert one(spark, lambda c: text.course_key(text.fold(c)), "MATH / 101") == "math-101"


@pytest.mark.parametrize(("a", "b", "d"), [("ab", "ba", 1), ("ca", "abc", 3), ("", "abc", 3), ("same", "same", 0), ("kitten", "sitting", 3)])
def test_osa(a, b, d):
    assert fuzzy.osa_distance(a, b) == fuzzy.osa_distance(b, a) == d


def test_osa_bounds():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(2))
        assert abs(len(a) - len(b)) <= fuzzy.osa_distance(a, b) <= max(len(a), len(b))


def test_best_match_takes_the_first_of_equals(spark):
    lexicon = spark.createDataFrame([(0, "x", "abcd"), (1, "y", "abce")], "ord int, key string, variant string")
    texts = spark.createDataFrame([("abcf",), ("abce",), ("zzzz",), (None,), ("",)], "t string")
    got = {r["text"]: (r["key"], round(r["score"], 2)) for r in fuzzy.best_match(texts, "t", lexicon, 0.7).collect()}
    assert got == {"abcf": ("x", 0.75), "abce": ("y", 1.0)}
