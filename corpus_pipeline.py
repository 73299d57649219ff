"""A corpus pipeline: each stage applies one operator to all that its predecessor kept.

``run`` writes the result of each stage as Parquet in the shared folder and reads it back.
Whole texts go to Python in three of the stages, ``ARROW_ROWS`` rows at a time: batches of 10 000
take tens of MB outside of the heap, many times over, and the workers keep that room. A stage that
is called by itself leaves the session so, as its result is computed when it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tessella.llm.common import arrow_rows, hold_arrow_rows, materialise, table, transient
from tessella.llm.simhash import ARROW_ROWS


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of characters counted anew."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, lets pass."""
    hold_arrow_rows(spark, ARROW_ROWS)
    model = toxicity.fit_on_open_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hold_arrow_rows(spark, ARROW_ROWS)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the copies that the mix takes of each."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself goes when it ends; the last
    one's tables, and the documents that it reads, stay for whoever reads the result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with transient(spark), arrow_rows(spark, ARROW_ROWS):
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted model and similarity groups are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None
