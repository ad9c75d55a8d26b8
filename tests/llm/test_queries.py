"""Registered queries beside their SQL, and the pipeline against plain Python stage by stage."""

from collections import Counter

import pytest
from compare import compare, connect

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gridloom.llm.queries import oracle_sql as mine
from test_decontaminate import brute
from test_duplicates import groups, slow_fingerprint
from test_rows import jump

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(mine()))
def test_matches_sql(spark, name):
    assert compare(queries()[name](spark, DIR), connect(DIR), oracle_sql()[name]) == []


def test_pipeline_stages(spark):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{DIR}/documents.parquet")
    first = stages["language_id"](spark, docs, DIR)
    assert first.columns == docs.columns and first.count() >= 0.97 * docs.count()
    rows = first.collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    distinct = sorted(set(fps.values()))
    roots = groups(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if bin(a ^ b).count("1") <= 2])
    best = {}
    for d, f in fps.items():
        best[roots[f]] = min(d, best.get(roots[f], d))
    second = stages["near_dedup"](spark, first, DIR)
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == set(best.values())
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r["doc_id"] for r in second.collect() if not brute(r["text"], bench)[4]}
    third = stages["decontamination"](spark, second, DIR)
    assert third.columns == docs.columns and {r["doc_id"] for r in third.collect()} == kept
    fourth = stages["mixing"](spark, third, DIR)
    assert fourth.columns == docs.columns
    mixed = fourth.collect()
    last = stages["sharding"](spark, fourth, DIR).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in last) == Counter((r["doc_id"], jump(r["doc_id"], 16)) for r in mixed)
    assert corpus_pipeline.run(spark, DIR).count() == len(last)
