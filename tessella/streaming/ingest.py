"""Streaming ingest: idempotent rollups, tumbling windows and deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessella.functions.storage import shared_path
from tessella.operators.profiles import event_tags, rollup_tags


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a file stream; the schema is read from the files that are there. It may be
    one file in the folder or a folder of files."""
    table = spark.read.parquet(f"{folder}/{name}")
    files = table.select("_metadata.file_name").limit(1).first()
    whole = files is None or files[0] == name
    stream = spark.readStream.schema(table.schema)
    return stream.option("pathGlobFilter", name).parquet(folder) if whole else stream.parquet(f"{folder}/{name}")


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Events as a file stream. Times without zone are taken in the session's, as watermarks need
    instants."""
    return table_stream(spark, folder, name).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", one_batch: bool = False) -> None:
    """Process all that is there and stop. The checkpoint makes a rerun go on where it ended. Streams
    that go by the machine's clock never run out of batches: they take ``one_batch``."""
    trigger = {"once": True} if one_batch else {"availableNow": True}
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    query.awaitTermination()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder for each batch: a replayed batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _result(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    path, at = shared_path(spark, name), shared_path(spark, f"{name}-state")
    run_available(stream, append_batches(path), at, mode)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def stream_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, code, day, weight``: partial rollups of the batches, then their sum."""
    path, at = shared_path(spark, "rollup"), shared_path(spark, "rollup-state")
    write = append_batches(path)
    run_available(event_stream(spark, folder), lambda batch, number: write(rollup_tags(event_tags(batch)), number), at)
    parts = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return parts.groupBy("user_id", "code", "day").agg(F.sum("weight").alias("weight"))


def upsert_batches(spark: SparkSession, path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink of changed rows: each batch is a folder of its own; ``latest_of`` reads the last
    row of each key. A replayed batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return write


def latest_of(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Of each key the row of its last batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def stream_windows(spark: SparkSession, folder: str, width: str = "1 hour", late: str = "10 minutes", path: str | None = None, state: str | None = None) -> DataFrame:
    """``start, event_type, n, score`` of tumbling windows.

    A batch writes the windows that it changed, so the same windows come again with later
    batches and replace what was there; events later than ``late`` behind the watermark are
    left out, and the state of windows behind it goes. With ``path`` and ``state`` kept, a
    later call goes on where the last one ended.
    """
    path, state = path or shared_path(spark, "windows"), state or shared_path(spark, "windows-state")
    stream = event_stream(spark, folder).withWatermark("ts", late)
    per = stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("score"))
    rows = per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "score")
    keys = ["start", "event_type"]
    run_available(rows, upsert_batches(spark, path, keys), state, "update")
    return latest_of(spark, path, rows.schema, keys)


def stream_distinct(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Events, each event_id once however often it is delivered within the watermark."""
    stream = event_stream(spark, folder).withWatermark("ts", late)
    return _result(spark, stream.dropDuplicatesWithinWatermark(["event_id"]), "distinct")
