"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import decontaminate, mixing, near_dups, quality, registry, sharding


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    a, b = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        ids, before = [r.doc_id for r in out.collect()], {r.doc_id for r in docs.collect()}
        assert set(ids) <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if name == "quality rules":
            assert set(ids) == {r.doc_id for r in quality.judged(docs).where("kept").collect()} and 0 < len(ids) < n
        elif name == "near duplicates":
            assert set(ids) == {r.doc_id for r in near_dups.near_duplicates(docs, words=5).where("kept").collect()} and len(ids) == len(set(ids))
        elif name == "benchmark decontamination":
            hit = {r.doc_id for r in decontaminate.scanned(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").collect()}
            assert set(ids) == before - hit
        elif name == "mixing sources":
            assert len(ids) == mixing.copies(docs).agg(F.sum("n_copies")).first()[0]
        else:
            assert len(ids) == docs.count() and out.where("shard_bytes > " + str(sharding.LIMIT)).count() == 0
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
