"""Queries on the smallest tables; the pipeline's stages against plain restatements."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from textloom.llm import near_dup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps, now = [], docs
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        steps.append({r.doc_id for r in now.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(steps, steps[1:], strict=False))
    known = [d for d in labels if labels[d] is not None]
    right = sum((d in steps[0]) == (labels[d] == 1) for d in known)
    assert right / len(known) > 0.9
    groups = near_dup.groups(docs.where(F.col("doc_id").isin(list(steps[0]))).select("doc_id", "text"))
    assert steps[1] == {r.component_id for r in groups.collect()}
    assert steps[3] == steps[2]
    mixed = cp.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in mixed} == steps[3] and all(r.taken <= 2 * r.size for r in mixed)
