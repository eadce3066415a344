import pytest
from check_oracles import compare, database

from trailcast.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_pipeline_stages_on_edge_documents(spark, edge_docs, tmp_path):
    import corpus_pipeline

    for table in (edge_docs, edge_docs.where("false")):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < 4:
                assert out.columns == edge_docs.columns
            path = str(tmp_path / f"{k}-{id(table)}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (0 if table is not edge_docs else docs.count())
