"""Work that is done once, and nothing that an earlier rule has found is looked for again; with the same results as the SQL."""

import re

import duckdb
import pytest

from writlake.functions import expressions as E
from writlake.functions import lexicons as L
from writlake.functions.dialect import DUCKDB, SPARK
from writlake.operators import documents as D
from writlake.operators import persons as P
from writlake.operators import targets as T
from writlake.plans import catalog

SF = "/root/testdata/sf0.001"
ODD = (None, "", " ", "\n", "|", "a|b", "\t a \x0b\x0c b\r\n\r\nc\r", "  x \t y  ", "أإآ ١٢۳ \\／⁄–—−：؛_~`^<>{}[]", " a \n b", "a \n \n b", "٠٩۰۹|\r|")


@pytest.mark.parametrize("operator", [E.normalize, E.collapse, E.squeeze, E.lines, E.clean_value, E.review_value])
def test_odd_texts_as_the_sql_has_them(spark, operator):
    # A vertical tab is white space to Spark's patterns and not to DuckDB's; lines are cut at it by both.
    texts = [x for x in ODD if operator is E.normalize or x is not None and (operator in (E.collapse, E.lines) or "\x0b" not in x)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").selectExpr("i", f"{operator(SPARK, 'x')} as v").orderBy("i").collect()
    c = duckdb.connect()
    expected = [c.execute(f"select {operator(DUCKDB, 'x')} from (select cast(? as varchar) as x)", [x]).fetchone()[0] for x in texts]
    assert [r.v for r in rows] == expected


def test_folds_are_the_four_translations(spark):
    signs = "".join(dict.fromkeys(L.ARABIC_DIGITS + L.EXTENDED_DIGITS + L.ALEF_FROM + L.SEPARATORS_FROM + "|" + L.GARBAGE + "aا/-:0"))
    one_by_one = E.strip_garbage(SPARK, E.fold_separators(SPARK, E.fold_alef(SPARK, E.digits(SPARK, "x"))))
    r = spark.createDataFrame([(signs,)], "x string").selectExpr(f"{one_by_one} as a", f"{SPARK.translate('x', *E.folds())} as b").first()
    assert r.a == r.b


def test_records_are_computed_once_in_their_dedupe():
    assert T.dedupe(SPARK, "made_somewhere").count("made_somewhere") == 1
    assert SPARK.extract("made_somewhere", "x").count("made_somewhere") == 1 and "nullif" not in SPARK.extract("x", "y")


def test_ids_that_were_found_are_not_looked_for(spark):
    text = "قررت المحكمة على احمد محمود سالم العبادي 98000000001\nو خالد سالم حسن حداد 98000000002"
    seen = "array(named_struct('national_id', '98000000001'), named_struct('national_id', cast(null as string)))"
    df = spark.createDataFrame([(text,)], "x string")
    for rule in (T.context_records, T.emergency_records):
        every, rest = (df.selectExpr(f"{r} as v").first().v for r in (rule(SPARK, "x"), rule(SPARK, "x", seen)))
        assert len(every) == 2
        assert rest == [v for v in every if v.national_id != "98000000001"]


def test_measured_accuracy_extracts_once(spark):
    plan = catalog.queries()["measured_accuracy"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"AS persons_first#", plan)) == 1


def test_lines_and_texts_are_computed_once():
    assert P.candidate_lines(SPARK, "made_somewhere").count("made_somewhere") == 1
    assert D.known_court(SPARK, "made_somewhere").count("made_somewhere") <= 2
