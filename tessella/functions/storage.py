"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Paths handed out inside of ``scratch`` blocks, innermost block last.
_open_blocks: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write for themselves inside the block go when it ends: what they return
    must have been written, collected or counted by then."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, a temporary folder in a
    local session, and an error on a cluster, whose machines would each have their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, __n, __run, __all`` of the values of each key that are not null: how many rows
    have the value, have it or a lesser one, and have any.

    The distinct values are range-partitioned by (key, value) and their counts added up along
    the ranges, so a key with many values spreads over tasks; one sum for each range comes to
    the driver.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = written(written(counts, "counts").repartitionByRange(parts, key, value).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = {r["__part"]: r.s for r in ranged.groupBy("__part").agg(F.sum("__n").alias("s")).collect()}
    before, offsets = 0, []
    for part in sorted(sums):
        offsets.append((part, before))
        before += sums[part]
    table = spark.createDataFrame(offsets, "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(key, value).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(F.broadcast(table), "__part").withColumn("__run", F.col("__before") + F.sum("__n").over(w))
    per = run.groupBy(key).agg(F.min(F.col("__run") - F.col("__n")).alias("__start"), F.sum("__n").alias("__all"))
    joined = run.join(per.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")))
    return joined.select(key, value, "__n", (F.col("__run") - F.col("__start")).alias("__run"), "__all")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows' numbers from 0 in ``order``. Rows are range-partitioned and numbered in
    their range; one count for each range comes to the driver."""
    spark = df.sparkSession
    ranged = written(df, "rows").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *order)
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("__part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["__part"]):
        offsets.append((r["__part"], before))
        before += r.n
    table = spark.createDataFrame(offsets, "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(*order)
    place = F.col("__before") + F.row_number().over(w) - 1
    return ranged.join(F.broadcast(table), "__part").withColumn(name, place).drop("__part", "__before")
