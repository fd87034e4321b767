"""The pipeline stage by stage, and the queries' SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from treeledger.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents after each stage."""
    found = [queries.documents(spark, SF)]
    for _, stage in corpus_pipeline.STAGES:
        found.append(_kept(spark, stage(spark, found[-1], SF)))
    return found


def _kept(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_and_poor_documents_go(spark, stages):
    known = {r.doc_id: r for r in queries.labels(spark, SF).collect()}
    all_ids, clean, good = (ids(df) for df in stages[:3])
    toxic = {i for i, r in known.items() if r.toxic}
    poor = {i for i, r in known.items() if not r.quality}
    assert len(toxic - clean) >= 0.7 * len(toxic) and not (all_ids - clean) & (known.keys() - toxic)
    assert len((poor & clean) - good) >= 0.95 * len(poor & clean)
    assert len((clean - good) & (known.keys() - poor)) <= 0.02 * len(known)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    wanted = {i for i, (_, c) in plain.ngram_components(rows, 5, 80).items() if i == c}
    assert ids(stages[3]) == wanted


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    masked = 0
    for row in stages[4].collect():
        old = before[row.doc_id]
        spans = [old.text[s:e] for found in plain.secrets(old.text).values() for s, e in found]
        assert all(span not in row.text for span in spans)
        assert row.text == old.text or "[SECRET]" in row.text
        assert (row.lang, row.source, row.n_chars) == (old.lang, old.source, len(row.text))
        masked += bool(spans)
    assert masked


def test_all_is_packed(stages):
    assert ids(stages[5]) == ids(stages[4])
    total = stages[5].selectExpr("sum(length)").first()[0]
    assert total == stages[5].dropDuplicates(["doc_id"]).selectExpr("sum(doc_tokens)").first()[0]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    wanted = connection.sql(queries.oracle_sql()[name]).df()
    found = df.toPandas()[list(wanted.columns)]
    key = list(wanted.columns)
    assert sorted(map(tuple, found.values.tolist())) == sorted(map(tuple, wanted[key].values.tolist()))
