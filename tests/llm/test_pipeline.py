import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dayscribe.llm import queries

from .test_operators import vectors

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        if name == "exact_dedup":
            texts = [hashlib.md5((r.text or "").encode()).digest() for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
        ids = now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == ids
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == rows.agg(F.sum("length")).first()[0]


def test_queries_run(spark):
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name, tmp_path):
    """On the driver's smallest tables, and for vectors on the tests' own, which hold links."""
    import duckdb

    fixture = spark.createDataFrame([r for r in vectors() if r[0] is not None and r[0] < 310], "vec_id long, embedding array<double>, label int")
    fixture.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for folder in [SF, str(tmp_path)] if name.startswith("op3") else [SF]:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark") if folder == SF else ("embeddings",):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
        rel = con.sql(queries.ORACLE_SQL[name])
        want = [tuple(sorted(zip(rel.columns, map(str, r)))) for r in rel.fetchall()]
        got = [tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in queries.QUERIES[name](spark, folder).collect()]
        assert sorted(got) == sorted(want)
