"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Stands for a null id inside an operator: it sorts last and joins with itself.
NULL_ID = 2**63 - 1
#: The ASCII whitespace [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def id_key(column: str | Column) -> Column:
    """The id as a long; null becomes ``NULL_ID``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def key_id(column: str) -> Column:
    """The inverse of ``id_key``."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add under these names."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for private columns, lengthened until ``df`` has none of them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Scratch tables of the innermost ``transient`` block, newest block last.
_open_blocks: list[list[str]] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    A local session that names none, as in tests, gets a temporary folder; on a cluster,
    where such a folder would be another one on each machine, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside the block are deleted at its end: what is used after it
    must have been written outside, by ``materialise(..., keep=True)``."""
    _open_blocks.append([])
    try:
        yield
    finally:
        discard(spark, *_open_blocks.pop())


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost
    executors cost a read only. A table to ``keep`` outlives the ``transient`` block."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    if keep and _open_blocks:
        _open_blocks[-1].remove(path)
        if len(_open_blocks) > 1:
            _open_blocks[-2].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more."""
    for df in tables:
        discard(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def bounded_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """The ``most`` rows with the least hashes of ``columns``. Rows that cannot be among them are
    left out by their hash first, so tasks send little more than that to the driver."""
    n, h = df.count(), F.xxhash64(*columns)
    if n > most:
        df = df.where(F.shiftrightunsigned(F.xxhash64(*columns).bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53)) < 1.2 * most / n)
    return df.orderBy(h, *columns).limit(most)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with running totals (doubles), in ``order`` and with the row itself, of ``sums``.

    Rows are range-partitioned, so no task holds them all; one row for each partition, its
    sums, comes to the driver. Ties of ``order`` take any order among themselves.
    """
    spark = df.sparkSession
    part, *names = unused(df, "part", *[f"run_{k}" for k in sums])
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn(part, F.spark_partition_id())
    dealt = materialise(dealt, name)
    per = sorted(dealt.groupBy(part).agg(*[F.sum(v).alias(k) for k, v in zip(names, sums.values())]).collect())
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before, out = dict.fromkeys(names, 0.0), []
    for row in per:
        out.append((row[part], *before.values()))
        before = {k: before[k] + (row[k] or 0) for k in names}
    # From Arrow: rows of plain values would start Python workers of another kind on every executor.
    kinds = pa.schema([(part, pa.int32()), *[(n, pa.float64()) for n in names]])
    offsets = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, row)) for row in out], kinds))
    totals = [(F.col(n) + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(k) for n, (k, v) in zip(names, sums.items())]
    return dealt.join(F.broadcast(offsets), part).select(*df.columns, *totals)


#: The session's setting of the rows that Python gets at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def hold_arrow_rows(spark: SparkSession, most: int) -> None:
    """Batches of ``most`` rows from here on, in all of the session: for results that are
    computed only when somebody writes them."""
    before = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(most, before) if before > 0 else most))


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of ``most`` rows for what runs inside the block: Spark fills a batch outside of its
    heap, in buffers that double, so rows with long lists or texts take their room many times."""
    before = spark.conf.get(BATCH)
    hold_arrow_rows(spark, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` at most: what a task makes of a piece stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
