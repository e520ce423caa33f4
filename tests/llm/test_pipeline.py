"""The pipeline's stages, each against a plain restatement on its own input."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from plumbrule.llm import quality, queries
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.mark.parametrize("name", sorted(queries.registry.sql))
def test_against_sql(spark, name):
    ok, note = compare(spark, name, queries.registry.queries[name], queries.registry.sql[name], SF, connect(SF))
    assert ok, note


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.registry.queries}
    assert "pipeline" in entry.queries() and set(queries.registry.sql) <= set(entry.oracle_sql())


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()], docs.columns))
    assert all(c[:5] == ["doc_id", "text", "lang", "source", "n_chars"] for *_, c in kept)
    classified, joined, clean, scanned, mixed = kept
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    one = quality._scorer(model)
    assert sorted(classified[1]) == sorted(r for r in classified[0] if one(r[1] or "") >= quality.THRESHOLD)
    heads = {c for _, c in brute.components_by_jaccard([r[:2] for r in joined[0]]).values()}
    assert sorted(joined[1]) == sorted(r for r in joined[0] if r[0] in heads)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination([r[:2] for r in clean[0]], items) if r[-1]}
    assert sorted(clean[1]) == sorted(r for r in clean[0] if r[0] not in dirty)
    assert {r[0] for r in scanned[1]} == {r[0] for r in scanned[0]}
    assert not any(brute.base_spans(r[1]) for r in scanned[1]) and all(r[4] == len(r[1]) for r in scanned[1])
    before = {r[0]: r for r in mixed[0]}
    assert all(r[:5] == before[r[0]] for r in mixed[1]) and 0 < len(mixed[1]) <= len(mixed[0])


def test_run_equals_the_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
