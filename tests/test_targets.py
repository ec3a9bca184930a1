"""The target list, names around ids, orphans, the extractor's dedupe, and the matching of persons: hand-made cases."""

import pytest
from pyspark.sql import functions as F

from writlake.functions.dialect import SPARK
from writlake.operators import evaluation as V
from writlake.operators import targets as T
from writlake.plans import catalog
from writlake.plans.flow import Flow


@pytest.fixture(scope="module")
def of(spark):
    def run(rule, text, **more):
        return spark.createDataFrame([(text,)], "x string").select(F.expr(rule(SPARK, "x")).alias("v")).first().v

    return run


def short(records):
    return [(r.full_name, r.national_id or r.registration_number, r.confidence, r.needs_review) for r in records]


def test_section_needs_its_heading(of):
    assert of(T.target_section, "سامي محمود حسن 98765432101") == ""
    assert of(T.target_section, "رقم\nالاشخاص المطلوبة\nسامي\nمرفق طيه\nخالد") == "الاشخاص المطلوبة سامي"


def test_listed_persons_and_companies(of):
    text = "الاشخاص / الجهات المطلوبة\n- سامي محمود حسن علي\nالرقم الوطني : 98765432101\nنوع الشخص : فرد\n- شركة النجمة للحلول التقنية\nرقم التسجيل : REG-202602\nوتفضلوا"
    assert short(of(T.listed, text)) == [("سامي محمود حسن علي", "98765432101", 0.9, False), ("شركة النجمة للحلول التقنية", "REG-202602", 0.9, False)]
    assert [r.person_type for r in of(T.listed, text)] == ["Individual", "Company"]


def test_an_id_that_comes_twice_gives_both_names(of):
    text = "الاشخاص\nسامي محمود حسن الرقم الوطني : 98765432101\nخالد ناصر عمر الرقم الوطني : 98765432101"
    got = of(T.listed, text)
    assert [(r.full_name, r.needs_review) for r in got] == [("سامي محمود حسن", True), ("خالد ناصر عمر", True)]


def test_context_takes_line_then_next_then_previous(of):
    assert short(of(T.context_records, "خالد ناصر عمر\n98765432101\nسامي محمود حسن")) == [("سامي محمود حسن خالد ناصر عمر"[-len("محمود حسن خالد ناصر عمر"):], "98765432101", 0.9, False)]
    assert of(T.context_records, "سامي 98765432101") == []


def test_emergency_is_weak(of):
    assert short(of(T.emergency_records, "هاتف 98765432101 سامي محمود حسن علي")) == [("سامي محمود حسن علي", "98765432101", 0.65, True)]


def test_orphans(of):
    assert of(T.orphan_names, "عمر\nالاشخاص\nسامي\nسامي محمود\nسامي\nفرد\nخالد") == ["سامي", "خالد"]


def records(spark, rows):
    kinds = "full_name:string,national_id:string,registration_number:string,person_type:string,confidence:double,needs_review:boolean,source:string,extraction_method:string"
    return spark.createDataFrame([(rows,)], f"r array<struct<{kinds}>>")


def test_dedupe_keeps_the_better_and_doubts_other_names(spark):
    one = lambda name, i, method, review=False: (name, i, None, "Individual", 0.9, review, "rules", method)
    rows = [one("سامي محمود حسن", "98765432101", "keyword_line", True), one("سامي محمود حسن", "98765432101", "structured_target_list"), one("خالد ناصر عمر", "98765432101", "keyword_line"), one("سامي محمود حسن", None, "keyword_line")]
    got = records(spark, rows).select(F.expr(T.dedupe(SPARK, "r")).alias("v")).first().v
    assert [(r.full_name, r.extraction_method, r.needs_review) for r in got] == [("سامي محمود حسن", "structured_target_list", True), ("خالد ناصر عمر", "keyword_line", True)]
    assert records(spark, []).select(F.expr(T.dedupe(SPARK, "r")).alias("v")).first().v == []


def test_a_name_that_is_there_uses_no_orphan_up(spark):
    one = lambda name, i: (name, i, None, "Individual", 0.9, False, "rules", "national_id_context")
    rows = records(spark, [one("سامي محمود حسن", "98765432101"), one("ناصر عمر علي", "98765432102"), one("هند علي حسن", "98765432103")])
    got = rows.select(F.expr(T.recover_orphans(SPARK, "r", "array('سامي', 'خالد')")).alias("v")).first().v
    assert [r.full_name for r in got] == ["سامي محمود حسن", "سامي ناصر عمر علي", "خالد هند علي حسن"]
    assert [r.confidence for r in got] == [0.9, 0.85, 0.85]


def test_later_texts_only_if_nobody_was_found(spark):
    page = "المدين سامي محمود حسن علي رقم وطني 98765432101"
    rows = [(1, page, page, page), (2, "", page, page), (3, "لا", None, "المدين سامي محمود\nحسن علي رقم وطني 98765432101"), (4, None, None, None)]
    flow = Flow(lambda s, d: s.createDataFrame(rows, "document_id int, a string, b string, c string"), "")
    got = catalog.with_fallbacks(flow, "a", "b", "c").spark(spark, "").select("document_id", "attempt", F.size("persons").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 0, 0)]


def person(name, i=None, kind="Individual"):
    return {"full_name": name, "national_id": i, "person_type": kind}


def test_persons_match_by_id_and_then_by_name():
    found = [person("سامي محمود حسن"), person("خالد", "1"), person("لا احد هنا")]
    review = [person("رنا", "1"), person("سامي محمود حسين"), person("خالد ناصر", "1"), person("هند", "2")]
    assert sorted(V.match_persons(found, review)) == [(0, 1), (1, 2)]  # of one id the last
    assert V.compared(found, review) == (2, 1, 2, 0, 2, 2)
    assert V.compared([], []) == (0, 0, 0, 0, 0, 0)


def test_report_without_rows(spark):
    none = spark.range(0).selectExpr("id as document_id", "cast(null as array<struct<full_name:string,national_id:string,person_type:string>>) as extracted", "cast(null as array<struct<full_name:string,national_id:string,person_type:string>>) as reviewed")
    got = V.report(V.detection_counts(none), spark.range(0).selectExpr("id as correct_fields", "id as total_fields")).first()
    assert (got.tp, got.precision, got.f1, got.overall_accuracy) == (0, 0.0, 0.0, 0.0)
