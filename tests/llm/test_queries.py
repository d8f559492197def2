"""The registered queries: SQL oracles over whole tables, and the pipeline."""

import duckdb
import pytest
from fixtures import corpus, frame

import corpus_pipeline
from basketry.llm.near_dedup import near_groups
from basketry.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.sql(ORACLE[name])
    columns = sorted(expected.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.select(*columns).fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs_on_whole_tables(spark, name):
    got = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = got.select("doc_id").distinct().count()
    assert found == docs.count() if name != "op1_decontamination" else 0 < found < docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        now = now.cache()
        sizes.append(now.count())
        assert now.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert now.exceptAll(docs).count() == 0
    assert near_groups(now, 5).where("not kept").count() == 0
    assert now.selectExpr("lower(text) as t").distinct().count() == sizes[-1]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert packed.selectExpr("sum(length)").first()[0] == packed.selectExpr("sum(size(ids))").first()[0]


def test_pipeline_on_awkward_rows(spark):
    """Nulls, empty and repeated rows pass every stage."""
    now = frame(spark, corpus(3)).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        if stage is not corpus_pipeline.packing:
            assert now.columns == columns
    assert now.count() > 0
