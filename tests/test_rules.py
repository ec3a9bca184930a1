"""Known values of single operators, and of the order-dependent folds."""

import difflib

import pytest
from pyspark.sql import functions as F

from writlake.functions import columns as C
from writlake.functions import lexicons as L
from writlake.functions.dialect import SPARK
from writlake.operators import documents as D
from writlake.operators import persons as P
from writlake.operators import records as R


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "date"), [("بتاريخ 2026/07/09", "2026/07/09"), ("التاريخ: 20260204", "2026/02/04"), ("التاريخ: 2026/0204", "2026/02/04"), ("بتاريخ 04/02/2026", "2026/02/04"), ("2026 / 8 / 2", "2026/08/02"), ("05/07/2026 ثم 2025/01/02", "2025/01/02"), ("2026/02/31", "2026/02/31"), ("123456789012026/01/01", None)])
def test_first_date(spark, text, date):
    assert one(spark, C.first_date("x"), x=text) == date


@pytest.mark.parametrize(("text", "number"), [("1204/2026", "1204/2026"), ("2026 - 41", "2026/41"), ("2026 1322", "1322/2026"), ("1322 2026", "1322/2026"), ("202641", "2026/41"), ("20260204", None), ("", None)])
def test_case_number(spark, text, number):
    assert one(spark, C.case_number("x"), x=text) == number


@pytest.mark.parametrize(("text", "number"), [("UW - 2026 - 0004", "UW-2026-0004"), ("0|-2026-0131", "UW-2026-0131"), ("U-2026-0101", "U-2026-0101"), ("x", None)])
def test_document_number(spark, text, number):
    assert one(spark, C.document_number("x"), x=text) == number


def test_ids_and_digits(spark):
    assert one(spark, C.national_ids("x"), x="123456789012345 و 98765432101 1234567890") == ["98765432101", "1234567890"]
    assert "1234/2026" in one(spark, C.normalize("x"), x="رقم القضية : ١٢٣٤/٢٠٢٦")
    assert one(spark, C.normalize("x"), x=None) == ""
    assert one(spark, C.normalize("x"), x="a|b~ \t c\r\n\n d ") == "a\nb c\nd"


def test_stop_phrases_are_cut_in_order(spark):
    assert one(spark, C.cut_stop_phrases("x"), x="سامي حامل الرقم الوطني 1") == "سامي حامل "


def test_registration_numbers(spark):
    assert one(spark, C.registration_shape("x"), x="RE6 - 202602") == "REG-202602"
    assert one(spark, C.registration("x"), x="رقم التسجيل: reg - 202602") == "REG-202602"
    assert one(spark, C.registration("x"), x="REG-202602 : رقم التسجيل") == "REG-202602"
    assert one(spark, C.registration("x"), x="لا شيء") is None


def test_review_norms(spark):
    assert one(spark, C.review_value("x"), x="REG - 202701") == "REG-202701"
    assert one(spark, C.review_date("x"), x="10/07/2026") == one(spark, C.review_date("x"), x="2026-07-10") == "2026-07-10"
    assert one(spark, C.review_value("x"), x="  ") is None


def test_ocr_quality(spark):
    assert one(spark, C.ocr_quality("x", "c"), x="", c=0.9) == 0.0
    good, bad = one(spark, C.ocr_quality("x", "c"), x="محكمة بداية عمان رقم القضية تاريخ", c=0.9), one(spark, C.ocr_quality("x", "c"), x="zzzz qqqq wwww eeee rrrr", c=0.9)
    assert 0 <= bad < good <= 1


def test_group_split(spark):
    split = lambda x: one(spark, F.expr(P.split_group(SPARK, "x")), x=x)
    assert split("أحمد ومحمد وخالد أبناء محمود سالم") == ["أحمد محمود سالم", "محمد محمود سالم", "خالد محمود سالم"]
    assert split("أحمد محمود سالم") == ["أحمد محمود سالم"]
    assert split("محمود بن سالم") == ["محم سالم", "د سالم"]


def test_direct_phrase(spark):
    got = one(spark, F.expr(P.direct_phrases(SPARK, "x")), x="المستدعى ضده سامي محمود حسن ورقم وطني (98765432101)")
    assert [(r.full_name, r.national_id) for r in got] == [("سامي محمود حسن", "98765432101")]
    assert one(spark, F.expr(P.direct_phrases(SPARK, "x")), x="المستدعى ضده سامي 1") == []


def test_court_words_that_stand_for_each_other():
    words = sorted({w for c in L.COURTS for w in c.split()})
    alike = {(a, b) for a in words for b in words if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.72}
    assert alike == set(D.ALIKE.items())


def test_courts_of_maan_resolve_to_amman(spark):
    assert one(spark, F.expr(D.known_court(SPARK, "x")), x="محكمة بداية معان") == "محكمة بداية عمان"
    assert one(spark, F.expr(D.known_court(SPARK, "x")), x="محكمة صلح عمان و محكمة بداية شمال عمان") == "محكمة بداية شمال عمان"
    assert one(spark, F.expr(D.known_court(SPARK, "x")), x="لا شيء") is None


def records(spark, rows):
    return spark.createDataFrame([(rows,)], f"r array<{R.RECORD}>")


def test_merge_is_ordered(spark):
    a = ("سامي محمود", "98765432101", None, "Individual", 0.9, False, "rules", "keyword_line")
    b = ("سامي محمود حسن علي", "98765432101", None, "Individual", 0.75, False, "ner", "nearby_ner_person")
    c = ("سامي محمود حسن علي كامل احمد ناصر", "98765432101", None, "Individual", 0.75, False, "ner", "nearby_ner_person")
    got = records(spark, [a, b, c]).select(R.dedupe_merge("r").alias("m")).first().m
    assert [(x.full_name, x.source) for x in got] == [(c[0], "ner")]  # a and b merge to "rules+ner", which no longer counts as a rule's record (trap T18): c wins and keeps its source
    alone = ("سامي محمود", None, "REG-1", "Individual", 0.5, True, "rules", None)
    got = records(spark, [a, alone]).select(R.dedupe_merge("r").alias("m")).first().m
    assert [(x.full_name, x.registration_number, x.source) for x in got] == [("سامي محمود", "REG-1", "rules")]
    assert records(spark, []).select(R.dedupe_merge("r").alias("m")).first().m == []


def test_output_dedupe(spark):
    a = ("سامي محمود حسن علي", "1", None, "Individual", 0.9, False, "rules", "keyword_line")
    b = ("سامي محمود", "1", None, "Individual", 0.9, False, "rules", "direct_legal_phrase")
    n = ("سامي محمود", None, None, "Individual", 0.5, True, "rules", "keyword_line")
    got = records(spark, [a, b, n, n, (None, *n[1:])]).select(R.dedupe_for_output("r").alias("m")).first().m
    assert [(x.full_name, x.extraction_method) for x in got] == [("سامي محمود", "direct_legal_phrase")]


def test_reading_order(spark):
    box = lambda x, y, t: ([[x, y], [x + 10, y], [x + 10, y + 10], [x, y + 10]], t, 0.9)
    rows = [box(0.0, 50.0, "د"), box(0.0, 1.0, "ب"), box(100.0, 0.0, "ا"), box(100.0, 51.0, "ج")]
    df = spark.createDataFrame([(rows,), ([],)], "r array<struct<bbox:array<array<double>>,text:string,conf:double>>")
    assert sorted(" ".join(x.v) for x in df.select(R.reading_order("r").alias("v")).collect()) == ["", "ا ب ج د"]
