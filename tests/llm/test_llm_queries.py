"""The registered queries against their SQL, and the pipeline."""

import pytest
from oracle import connect, same

import corpus_pipeline
from assayer.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_match_sql(name, spark, sf, con):
    same(queries.QUERIES[name](spark, sf), con, queries.SQL[name])


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert kept.columns == docs.columns and set(ids) < before and len(ids) == len(set(ids)), name
        before, docs = set(ids), kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.filter("round_trip").collect()} == before
    assert corpus_pipeline.run(spark, sf).count() == len(before)
