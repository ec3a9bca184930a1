"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from writlake.plans import catalog
from writlake.plans.flow import Flow

SF = "/root/testdata/sf0.001"
FLOWS = catalog.flows()


@pytest.fixture(scope="module")
def tables():
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(columns, got):
    keep = sorted(columns)
    return sorted((tuple(round(r[columns.index(k)], 9) if isinstance(r[columns.index(k)], float) else r[columns.index(k)] for k in keep) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(FLOWS))
def test_query_equals_sql(spark, tables, name):
    df = FLOWS[name].spark(spark, SF)
    relation = tables.sql(FLOWS[name].duckdb)
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert "persons" in df.columns


def by_hand(spark, columns, rows):
    names = [c.split()[0] for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in r) + ")" for r in rows)
    return Flow(lambda s, d: spark.createDataFrame(rows, columns), f"select * from (values {values}) t({', '.join(names)})")


def test_measured_accuracy_counts_persons(spark):
    """A document with a changed, a removed and an added person, and one that is kept but for spaces."""
    auto = by_hand(spark, "document_id long, record_index int, a_name string, a_id string, a_reg string, a_type string", [(1, 1, "A B C", "98000000001", None, "Individual"), (1, 2, "D E F", "98000000002", "REG-1", "Individual"), (1, 3, "G", None, "REG - 2", "Company")])
    review = by_hand(spark, "document_id long, record_index int, r_name string, r_id string, r_reg string, r_type string", [(1, 1, "A B X", "98000000001", None, "Individual"), (1, 3, "G ", None, "REG-2", "Company"), (1, None, "H I J", "98000000003", None, "Individual")])
    four = by_hand(spark, "document_id long, field string, auto_value string, reviewed_value string", [(1, "court_name", "x", "x"), (1, "case_number", "1/2026", "2/2026"), (1, "document_number", "UW-2026-1", "UW - 2026 - 1"), (1, "document_date", "2026/07/10", "10/07/2026")])
    flow = catalog.accuracy(catalog.measured(four.union(catalog.person_field_results(auto, review))), "document_id")
    # 3 of 4 fields; 2 of 3 for the changed person, 3 of 3 for the kept one, none of the removed and the added one.
    assert [tuple(r) for r in flow.spark(spark, "").collect()] == [(1, 16, 8, 8, 50.0)]
    assert duckdb.sql(flow.duckdb).fetchall() == [(1, 16, 8, 8, 50.0)]
    fields = {r.field: (r.total_fields, r.correct_fields, r.accuracy) for r in catalog.field_accuracy(catalog.exact(four)).spark(spark, "").collect()}
    assert fields == {"court_name": (1, 1, 1.0), "case_number": (1, 0, 0.0), "document_number": (1, 0, 0.0), "document_date": (1, 0, 0.0)}
    thirds = by_hand(spark, "document_id long, field string, auto_value string, reviewed_value string", [(1, "court_name", "x", " x"), (2, "court_name", "x", "y"), (3, "court_name", None, "")])
    assert [r.accuracy for r in catalog.field_accuracy(catalog.exact(thirds)).spark(spark, "").collect()] == [0.6667]


def test_measured_accuracy_of_the_corpus(spark):
    """A document without edits: two persons found, the company added by the review, three fields each."""
    rows = {r.document_id: (r.total_fields, r.correct_fields, r.accuracy) for r in catalog.queries()["measured_accuracy"](spark, SF).where("document_id in (5, 9)").collect()}
    assert rows == {5: (13, 10, 76.9), 9: (13, 10, 76.9)}


def test_rollup_decides_engine_and_status(spark):
    """The most pages win, ties go to the engine seen first, and nothing wins without a success."""
    pages = [(1, 1, "easyocr"), (1, 2, "tesseract"), (1, 3, "tesseract"), (2, 1, "tesseract"), (2, 2, "easyocr"), (3, 1, None), (3, 2, None), (4, 1, None), (4, 2, None), (4, 3, "easyocr")]
    flow = catalog.rollup(by_hand(spark, "document_id long, page_number long, selected_engine string, needs_review boolean, fallback boolean", [(*x, x[2] is None, False) for x in pages]))
    columns = ("document_id", "pages", "ok_pages", "to_review", "selected_engine", "ocr_status")
    expected = [(1, 3, 3, 0, "tesseract", "success"), (2, 2, 2, 0, "tesseract", "success"), (3, 2, 0, 2, None, "failed"), (4, 3, 1, 2, "easyocr", "success")]
    assert sorted(tuple(r[c] for c in columns) for r in flow.spark(spark, "").collect()) == expected
    assert duckdb.sql(f"select {', '.join(columns)} from ({flow.duckdb}) order by 1").fetchall() == expected
