import os

import pytest

D = "/root/testdata/sf0.001"


def test_stage_names():
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "mixing sources", "packing"]
    assert c.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_pipeline_runs_and_each_stage_takes_effect(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in c.STAGES[:-1]:
        docs = c.materialize(stage(spark, docs, D), "test")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0
    pieces = c.pack(spark, docs, D)
    assert pieces.select("sequence_id").distinct().count() <= pieces.count()


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
