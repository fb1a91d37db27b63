"""The pipeline, stage by stage, and the registered queries against their SQL."""

import pytest
from check_oracle import connect, differences

import __spark_entry__ as entry
import corpus_pipeline
from shapescreen.llm.oracle import oracle_sql
from shapescreen.sources.store import stage

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SMALL), SMALL, name) == []


def test_all_queries_are_registered():
    numbers = {name.split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert {f"op{n}" for n in range(1, 11)} <= numbers and "pipeline" in entry.queries()


def test_stages_over_awkward_rows(spark, awkward, nothing):
    for rows in (awkward, nothing):
        docs = rows
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = stage(step(spark, docs, SMALL), "test-stage")
            assert docs.columns == awkward.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert (last.count() > 0) == (rows is awkward)
        if rows is awkward:
            kept = {r.doc_id: r.text for r in docs.collect()}
            # 2 repeats 1; 4 to 7 have no language; 9 is a near copy of 8.
            assert set(kept) == {1, 8, 10, 11, 12, 13}
            assert "[CARD]" in kept[12]


def test_run_over_the_small_corpus(spark):
    got = corpus_pipeline.run(spark, SMALL)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got.select("doc_id").distinct().count() <= documents.count()
    assert got.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
