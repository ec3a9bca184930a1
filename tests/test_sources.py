"""Sources, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from writlake.sources import files
from writlake.streaming import reviews


def test_ingest_numbers_files(spark, tmp_path):
    for name in ("7.pdf", "b.PNG", "a.jpg", "x.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r.path.rsplit("/")[-1]: (r.document_id, r.extension) for r in files.ingest(spark, str(tmp_path)).collect()}
    assert got == {"7.pdf": (7, "pdf"), "a.jpg": (8, "jpg"), "b.PNG": (9, "png")}


def result(i, name, persons):
    field = {"value": name, "confidence": 0.9, "needs_review": False}
    return {"document_id": i, "document": {k: field for k in ("court_name", "case_number", "document_number", "document_date")}, "persons": persons, "reviewed": False}


def test_results_pairs_and_exports(spark, tmp_path):
    person = {"full_name": "n", "national_id": "1", "person_type": "Individual", "confidence": 0.9, "needs_review": False, "source": "rules", "record_index": 0}
    for folder, rows in (("a", [result("1", "x", [person, person]), result("2", "y", [])]), ("b", [result("1", "z", [])])):
        (tmp_path / folder).mkdir()
        for r in rows:
            (tmp_path / folder / f"{r['document_id']}.json").write_text(json.dumps(r, ensure_ascii=False))
    auto, review = files.read_results(spark, f"{tmp_path}/a"), files.read_results(spark, f"{tmp_path}/b")
    both, rest = files.paired(auto, review)
    assert [r.document_id for r in both.collect()] == ["1"] and [r.document_id for r in rest.collect()] == ["2"]
    best = {r.document_id: (r.result.document.court_name.value, r.reviewed) for r in files.best_available(auto, review).collect()}
    assert best == {"1": ("z", True), "2": ("y", False)}
    rows = files.export_rows(auto).orderBy("document_id").collect()
    assert [(r.document_id, r.full_name) for r in rows] == [("1", "n"), ("1", "n"), ("2", None)]
    assert json.loads(files.export_json(review).first().json)["persons"] == []
    files.write_results(review, f"{tmp_path}/out", reviewed=True)
    assert spark.read.parquet(f"{tmp_path}/out").first().reviewed is True
    got = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "x double").select(files.finite("x").alias("x")).collect()
    assert [r.x for r in got] == [None, None, 1.5]


def test_streams(spark, tmp_path):
    texts = spark.createDataFrame([(1, "التاريخ: ٢٠٢٦/٠٢/٠٤ 98765432101")], "document_id long, full_page_text string")
    texts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(texts.schema).parquet(f"{tmp_path}/in")
    reviews.clean_stream(stream).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    row = spark.table("cleaned").first()
    assert (row.national_ids, row.first_date) == (["98765432101"], "2026/02/04")
    kind = "document_id long, reviewed_at long, version int, value string"
    for rows in ([(1, 5, 1, "a"), (2, 5, 1, "b")], [(1, 6, 1, "c"), (2, 4, 9, "old")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/reviews")
        s = spark.readStream.schema(kind).parquet(f"{tmp_path}/reviews")
        reviews.keep_latest(s, f"{tmp_path}/table", f"{tmp_path}/c2").awaitTermination()
    assert sorted((r.document_id, r.value) for r in spark.read.parquet(f"{tmp_path}/table/v1").select("document_id", F.col("value")).collect()) == [(1, "c"), (2, "b")]
