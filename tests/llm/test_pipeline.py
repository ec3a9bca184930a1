"""The pipeline's stages on small tables: what goes, what stays, and what the last one packs."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as pipeline
from writlake.llm import mixing, queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == pipeline.COLUMNS
        sizes.append(docs.count())
        if i == 0:
            assert sizes[1] >= sizes[0] - 2 * max(len(toxic), 15)
        if i == 2:
            assert sizes[3] == sizes[2]
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_mixing_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    relation = c.sql(mixing.oracle_sql())
    df = queries.op4_mix_sources(spark, SF)
    keep = sorted(df.columns)
    assert keep == sorted(relation.columns)
    key = lambda rows, names: sorted(tuple(r[names.index(k)] for k in keep) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(relation.fetchall(), relation.columns)


def planted(spark):
    """Clean documents, exact and near copies, a passage of over 50 words in two others, and toxic rows."""
    random.seed(7)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ln", "rt", "sk", "m", "nd")]
    prose = lambda n: " ".join(random.choice(words) + str(random.randrange(50)) for _ in range(n))
    clean = {i: prose(120) for i in range(60)}
    passage = prose(55)
    rows = dict(clean)
    rows |= {100: clean[0], 101: clean[1].replace(clean[1].split()[60], "changed", 1)}
    rows |= {110: prose(60) + " " + passage + " " + prose(60), 111: prose(50) + " " + passage + " " + prose(70)}
    rows |= {200 + i: prose(40) + " vileword hateword " + prose(20) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, passage, docs


def test_stages_catch_what_is_planted(spark, tmp_path):
    rows, passage, docs = planted(spark)
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i in rows if i < 200}
    single = pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    assert {r.doc_id for r in single.collect()} == {i for i in rows if i < 200} - {100, 101}
    cut = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, single, str(tmp_path)).collect()}
    assert all(cut[i] == rows[i] for i in cut if i < 100)
    assert all(passage not in cut[i] and len(cut[i]) < len(rows[i]) - len(passage) + 10 for i in (110, 111))


def test_stages_take_nothing_and_odd_rows(spark, tmp_path):
    """Empty tables give empty tables; nulls and columns of other names don't matter."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None, "k"), (None, "a b c", "en", "s", 5, "k"), (2, "", "en", None, 0, None)], "doc_id long, text string, lang string, source string, n_chars long, key string")
    for df in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            df = spark.createDataFrame(stage(spark, df, str(tmp_path)).collect(), ", ".join(f"{n} {t}" for n, t in zip(pipeline.COLUMNS, ("long", "string", "string", "string", "long"), strict=True)))
        pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count()
