"""What the pipeline's Python holds at a time, and which workers it starts."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import common, decontaminate, simhash, toxicity

SMALL = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def docs(spark, tmp_path):
    """Two thousand documents in one partition; the session's batches are as before afterwards."""
    before = spark.conf.get(BATCH)
    spark.read.parquet(f"{SMALL}/documents.parquet").crossJoin(spark.range(10).select(F.col("id").alias("copy"))).drop("copy").coalesce(1).write.parquet(f"{tmp_path}/docs")
    yield spark.read.parquet(f"{tmp_path}/docs").coalesce(1)
    spark.conf.set(BATCH, before)


def test_toxicity_scores_few_texts_at_a_time(spark, docs, monkeypatch):
    def scorer(sent):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(b.num_rows > 512)] * b.num_rows)], [*b.schema.names, "score"])

        return run

    monkeypatch.setattr(toxicity, "_scorer", scorer)
    assert corpus_pipeline.drop_toxic(spark, docs, SMALL).count() == docs.count() > 512


def test_decontamination_scans_few_texts_at_a_time(spark, docs, monkeypatch):
    def scanner(block, window, kind, names):
        def run(batches):
            for b in batches:
                found = [[0, 1] if b.num_rows > 512 else []] * b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([1] * b.num_rows), pa.array(found, pa.list_(pa.int64())), pa.array([[]] * b.num_rows, pa.list_(kind))], [*b.schema.names, *names])

        return run

    monkeypatch.setattr(decontaminate, "_scanner", scanner)
    assert corpus_pipeline.drop_contaminated(spark, docs, SMALL).count() == docs.count() > 512


def test_the_pipeline_leaves_batches_as_they_were(spark):
    before = spark.conf.get(BATCH)
    corpus_pipeline.run(spark, SMALL)
    assert spark.conf.get(BATCH) == before


def test_running_totals_start_no_workers_for_plain_values(spark):
    rows = spark.range(50).select(F.col("id").alias("a"))
    found = common.running_totals(rows, [F.col("a")], {"n": F.lit(1)}, "totals")
    assert "ExistingRDD" not in found._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.n for r in found.orderBy("a").collect()] == list(range(1, 51))


def test_a_shard_is_compared_in_small_pieces():
    """Random fingerprints that no median divides at this radius."""
    fps = np.random.default_rng(3).integers(0, 2**63, 6000).astype(np.uint64)
    tracemalloc.start()
    simhash.link_within(fps, np.arange(6000) >= 3000, 2, least=6000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
