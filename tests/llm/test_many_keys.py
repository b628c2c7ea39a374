"""Mixing of very many sources, vectors of very many dimensions, and equal rows in token files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayscribe.llm import embedding_dedup, mixing, token_files

from .test_operators import plain_targets


@pytest.mark.parametrize("ranked", [1 << 20, 5])
def test_targets_of_many_sources(spark, monkeypatch, ranked):
    """Also ranked by ranges, and where resharing takes many rounds."""
    monkeypatch.setattr(mixing, "RANKED", ranked)
    r = np.random.default_rng(6)
    sizes = {f"s{k:03d}": int(2 ** r.uniform(0, 24)) for k in range(150)} | {None: 7, "": 0, "é": 10**9}
    df = spark.createDataFrame([(k is None, k or "", n) for k, n in sizes.items()], "none boolean, source string, source_size long").repartition(4)
    got = {None if x.none else x.source: x for x in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert {k: x.target for k, x in got.items()} == pytest.approx(want, rel=1e-9)
    assert [got[k].rank for k in sorted(sizes, key=lambda k: (k is None, k or ""))] == list(range(len(sizes)))
    assert sum(x.target for x in got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("turned,tile", [(1024, 1 << 20), (8, 1 << 20), (8, 64)])
def test_vectors_of_many_dimensions(spark, monkeypatch, turned, tile):
    """Only the first dimensions are turned; all count. A label of two long vectors needs no matrix of their length squared."""
    monkeypatch.setattr(embedding_dedup, "TURNED", turned)
    r = np.random.default_rng(7)
    base = r.normal(size=(4, 40))
    rows = [(k, (base[k % 4] + r.normal(size=40) * (0.02 if k % 3 else 0.4)).tolist(), k % 2) for k in range(80)]
    long = r.normal(size=60_000)
    rows += [(900, long.tolist(), 5), (901, (long * 2).tolist(), 5), (902, r.normal(size=60_000).tolist(), 5)] if tile > 64 else []
    v = np.array([np.array(x) / np.linalg.norm(x) for _, x, _ in rows[:80]])
    near = (v @ v.T >= 0.98) & (np.arange(80)[:, None] % 2 == np.arange(80) % 2)
    want = {k: int(near[k].sum()) - 1 for k in range(80)} | ({900: 1, 901: 1, 902: 0} if tile > 64 else {})
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert {x.vec_id: x.n_links for x in embedding_dedup.near_duplicates(df, tile=tile).collect()} == want


def test_equal_rows_are_dealt_out(spark):
    """A third of all rows without an id or a text are several tasks'."""
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("some text")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = token_files._ordered(docs.repartition(4), "text", "doc_id").withColumn("p", F.spark_partition_id())
        assert rows.filter("doc_id is null").select("p").distinct().count() > 1 and rows.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
