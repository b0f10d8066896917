"""The registered queries against their SQL, the pipeline against its stages' rules, and plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracles import TABLES, rows_of
from parlance.llm import minhash_dedup
from parlance.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_registered():
    names = queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df, want = QUERIES[name](spark, SMALL), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_quality_rules_are_native(spark):
    plan = QUERIES["op7_quality_rules"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = docs.columns

    kept = corpus_pipeline.stored(stages["quality"](spark, docs, SMALL), "t")
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert kept.join(good.select("doc_id"), "doc_id").count() >= 0.97 * good.count()
    assert kept.exceptAll(docs).count() == 0

    one = corpus_pipeline.stored(stages["near_dedup"](spark, kept, SMALL), "t")
    classes = minhash_dedup.near_duplicates(kept)
    want = {r.class_id for r in classes.collect()}
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(want)

    cut = corpus_pipeline.stored(stages["substring"](spark, one, SMALL), "t")
    assert cut.columns == columns and cut.where("n_chars <> length(text)").count() == 0
    again = corpus_pipeline.substring_dedup.remove_repeats(cut)
    assert cut.count() <= one.count() and again.agg(F.sum("n_removed")).first()[0] == 0

    mixed = corpus_pipeline.stored(stages["mix"](spark, cut, SMALL), "t")
    words = F.sum(corpus_pipeline.word_count(F.col("text")))
    assert mixed.columns == columns
    assert mixed.agg(words).first()[0] == pytest.approx(1.5 * cut.agg(words).first()[0], rel=0.02)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2

    ids = stages["encode"](spark, mixed, SMALL)
    assert ids.count() == mixed.count() and ids.where("not round_trip").count() == 0


def test_pipeline_bears_odd_rows(spark, odd, none):
    for frame, rows in ((odd, odd.count()), (none, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, frame, SMALL), "t")
            assert out.columns == frame.columns
            if name in ("quality", "near_dedup", "substring"):
                assert out.count() <= rows
        assert corpus_pipeline.encode(spark, frame, SMALL).count() == rows
