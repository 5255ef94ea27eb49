"""Queries with a DuckDB text agree with it; all queries run at the smallest scale."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from check import compare
from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(queries.SQL[name])
    assert compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) is None


def test_pipeline_keeps_clean_documents(spark):
    """Stage by stage: columns of documents until the last, and only what a stage is for goes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "language_id", "near_duplicates", "mixing_sources", "sentence_pieces"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    good = stages["quality_classifier"](spark, docs, SF)
    assert good.columns == columns
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert kept <= before and all(d in kept for d, q in labels.items() if q == 1 and d in before)
    found = stages["language_id"](spark, docs, SF)
    assert found.columns == columns and found.count() == len(before)
    once = stages["near_duplicates"](spark, docs, SF)
    assert once.columns == columns
    mix = stages["mixing_sources"](spark, docs, SF)
    assert mix.columns == columns
    times = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3
    last = stages["sentence_pieces"](spark, docs, SF)
    assert last.count() == len(before) and last.where("not exact").count() == 0


def test_pipeline_runs(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.count() > 0 and result.where("not exact").count() == 0
