"""The pipeline's stages on a table with planted cases, and every registered query's columns."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from test_training_data import DOCS, clashing, docs, empty, prose, rows  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages_keep_columns_and_take_effect(spark, clashing, tmp_path):  # noqa: F811
    rest = clashing
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rest, str(tmp_path))
        if name != "packing":
            assert out.columns == clashing.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        after = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "packing":
            assert 0 < after.count() < rest.count()
        rest = after
    assert rest.count() > 0


def test_empty_table_passes_every_stage(spark, empty, tmp_path):  # noqa: F811
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    fill = {r["sequence_id"]: r["n"] for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert max(fill.values()) <= 1024 and np.mean(list(fill.values())) > 900


def test_queries_run_on_whole_tables(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, query in entry.queries().items():
        if name[:2] == "op" and name[2].isdigit() and name.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op8", "op9"):
            assert query(spark, SMALL).select("doc_id").distinct().count() == n
