import unicodedata

import pytest
from pyspark.sql import functions as F

from shirabe.functions import text as t
from shirabe.operators.extract import clamp_threshold


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "a string").select(make(F.col("a")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("(12) 信号機", "信号機"), ("第3章信号", "信号"), ("700系", "系"), ("2-3番線", "3番線"), ("「架 線」", "架線"), ("", ""), ("・・", "")],
)
def test_clean(spark, given, wanted):
    assert one(spark, given, t.clean_candidate) == wanted


@pytest.mark.parametrize(("term", "good"), [("信号", True), ("系", False), ("3番線", False), ("すべて", False), ("あｱ", False), ("AB", True), ("a" * 40, True), ("a" * 41, False), ("のATS", True), ("--", False)])
def test_valid(spark, term, good):
    assert one(spark, term, t.valid_candidate) is good


@pytest.mark.parametrize(("term", "n", "score"), [("新幹線運転", 1, 0.88), ("新幹線運転", 2, 0.92), ("ATS", 1, 0.64), ("制御システム", 8, 0.98), ("方式", 2, 0.56)])
def test_score(spark, term, n, score):
    assert one(spark, term, lambda c: t.heuristic_score(c, F.lit(n))) == pytest.approx(score)


def test_normalize(spark):
    assert one(spark, "﻿ＡＴＳ\t　x\r\n\n\n\ny ", t.normalize_text) == "ATS x \n\ny"
    assert one(spark, None, t.normalize_text) == ""


def records(spark, text):
    df = spark.createDataFrame([(text,)], "a string").select(t.normalize_text(F.col("a")).alias("n"))
    row = df.select(t.paged_sentences(F.col("n")).alias("p"), t.unpaged_sentences(F.col("n")).alias("u")).first()
    return [tuple(r) for r in (row["p"] or row["u"])]


def test_pages_and_sentences(spark):
    assert records(spark, "前文。\n[[PAGE 2]]\n閉そく。方式！次\n [[PAGE 9]] \nx\n終わり") == [(None, "前文。"), (2, "閉そく。"), (2, "方式!次"), (9, "終わり")]
    assert records(spark, "[[PAGE 1]]") == [(None, "[[PAGE 1]]")]
    assert records(spark, "a [[PAGE 1]] b\nc d") == [(None, "a [[PAGE 1]] b"), (None, "c d")]
    assert records(spark, "") == []
    assert records(spark, "[[PAGE 99999999999999]]\nあい") == [(None, "あい")]


def test_spans_offsets(spark):
    got = one(spark, "この信号機（ATS）を700系で使う。", t.candidate_spans)
    assert [(s["start_char"], s["end_char"], s["candidate"]) for s in got] == [(2, 5, "信号機"), (6, 9, "ATS")]
    long = one(spark, "あ" + "架" * 41 + "い" + "線" * 42, t.candidate_spans)
    assert [(s["start_char"], s["end_char"]) for s in long] == [(1, 41), (43, 83), (83, 85)]


@pytest.mark.parametrize(("value", "cell"), [("-1", '"\'-1"'), (None, '""'), ('a"b', '"a""b"'), ("=x", '"\'=x"'), ("plain", '"plain"')])
def test_csv_cell(spark, value, cell):
    assert one(spark, value, t.csv_cell) == cell


def test_small_functions(spark):
    assert one(spark, "x" * 29, t.short_name) == "x" * 25 + "…"
    assert one(spark, None, t.short_name) == ""
    assert one(spark, "Manual.PDF", t.extension) == ".pdf"
    assert one(spark, "noext", t.extension) == ""
    assert one(spark, ".zip", t.mime_type) == "application/octet-stream"
    assert one(spark, "あ.txt".encode().decode("latin-1"), t.mojibake_repaired) == "あ.txt"
    assert one(spark, "é.txt", t.mojibake_repaired) == "é.txt"
    assert one(spark, "あ.txt", t.mojibake_repaired) == "あ.txt"
    assert one(spark, "../x", t.is_uuid) is False
    assert one(spark, "3f183a27-c98f-4a2b-a508-1c9c102022de", t.is_uuid) is True
    assert one(spark, None, t.is_status) is False
    assert one(spark, "a.b a.b", lambda c: t.highlighted(c, F.lit("a.b"))) == "<mark>a.b</mark> <mark>a.b</mark>"
    assert one(spark, "x.txt: 文", lambda c: t.evidence_text(c, F.lit("x.txt"))) == "文"
    assert unicodedata.normalize("NFKC", "ｱ") == "ア"


@pytest.mark.parametrize(("value", "wanted"), [(None, 0.9), ("x", 0.9), (float("nan"), 0.9), (0.1, 0.5), (2, 0.98), ("0.7", 0.7)])
def test_threshold(value, wanted):
    assert clamp_threshold(value) == wanted
