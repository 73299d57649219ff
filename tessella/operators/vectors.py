"""Vector search, centroids, bridges between vector spaces, and rescoring by neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions.storage import shared_path

#: Query vectors of a block, and vectors that a task compares with them at once.
QUERY_BLOCK, TILE = 1024, 4096
#: Bytes of the vectors of which a task keeps one list of best ones for each query: those of a
#: usual partition, so that it reads the queries once.
CHUNK_BYTES = 128 << 20
AXES = list(S.AXES)


def normalised(vector: str) -> F.Column:
    """The vector over its length, in doubles; a zero vector stays."""
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def fitting(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` numbers, none of them null."""
    return df.where((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))


def knn_cosine(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, neighbour_id, similarity, rank``: the ``k`` most similar rows of ``base`` for
    each query, itself left out; ties by id.

    Queries are written to the shared folder once, in blocks of ``QUERY_BLOCK``, which every
    task reads for itself: the base is read once, and for ``CHUNK_BYTES`` of its vectors ``k``
    rows of each query are shuffled. Vectors of zeros have similarity 0; null ones, those that hold a
    null, and those of another length than most queries are left out.
    """
    spark = base.sparkSession
    empty = spark.createDataFrame([], "query_id long, neighbour_id long, similarity double, rank int")
    dim = queries.where(F.col(vector).isNotNull()).agg(F.mode(F.size(vector))).first()[0]
    if not dim:
        return empty
    asked = fitting(queries, vector, dim).select(F.col(id_col).cast("long").alias("i"), normalised(vector).alias("v"))
    root = shared_path(spark, "queries")
    asked.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(root)
    files = [f for f in spark.read.parquet(root).inputFiles()]
    unit = fitting(base, vector, dim).select(F.col(id_col).cast("long").alias("i"), normalised(vector).alias("v"))

    def search(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for file in files:
            fs, path = pafs.FileSystem.from_uri(file)
            block = pq.read_table(path, filesystem=fs, columns=["i", "v"], partitioning=None).combine_chunks()
            if not block.num_rows:
                continue
            own = block.column("i").to_numpy()
            matrix = block.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
            best_s, best_i = np.empty((len(own), 0)), np.empty((len(own), 0), np.int64)
            for at in range(0, len(ids), TILE):
                i = ids[at : at + TILE]
                s = np.round(matrix @ vectors[at : at + TILE].T, 6)
                s[own[:, None] == i[None, :]] = -np.inf
                s, j = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(i, s.shape)])
                keep = np.lexsort((j, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, keep, 1), np.take_along_axis(j, keep, 1)
            q = np.repeat(own, best_s.shape[1])
            found = np.isfinite(best_s.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (q, best_i.ravel(), best_s.ravel())], ["query_id", "neighbour_id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("i").to_numpy(), batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)))
                size += batch.num_rows
            if size * dim * 8 >= CHUNK_BYTES:
                yield from search(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield from search(*map(np.concatenate, zip(*held)))

    found = unit.mapInArrow(run, "query_id long, neighbour_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_to(vector: str, target: list[float]) -> Column:
    """Cosine similarity of a column to one vector; 0 where either is all zeros."""
    t = np.asarray(target, float)
    length = float(np.sqrt((t * t).sum()))
    unit = F.array(*[F.lit(float(x / length)) if length else F.lit(0.0) for x in t])
    return F.aggregate(F.zip_with(normalised(vector), unit, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def match_one(base: DataFrame, target: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None, exclude: object | None = None) -> DataFrame:
    """``id_col, similarity`` of the ``k`` rows nearest to one vector, of those that ``where`` lets
    pass (a prefix of a code, grounded ones); ties by id."""
    rows = fitting(base, vector, len(target))
    rows = rows if where is None else rows.where(where)
    rows = rows if exclude is None else rows.where(F.col(id_col) != F.lit(exclude))
    return rows.select(id_col, F.round(cosine_to(vector, target), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def padded(vector: str, width: int) -> Column:
    """The vector repeated to ``width`` numbers, over its length; empty for an empty one."""
    v = F.col(vector).cast("array<double>")
    tiled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(v, i % F.size(v)))
    length = F.sqrt(F.aggregate(tiled, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(v) > 0, F.transform(tiled, lambda x: F.when(length > 0, x / length).otherwise(0.0))).otherwise(F.array().cast("array<double>"))


def folded(vector: str, width: int) -> Column:
    """The sum of a vector's parts of ``width`` numbers, over its length; null where they do not divide it."""
    v = F.coalesce(F.col(vector), F.array()).cast("array<double>")
    parts = lambda i: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int") - 1), lambda p: F.coalesce(F.get(v, (p * width + i).cast("int")), F.lit(0.0)))
    added = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(parts(i), F.lit(0.0), lambda s, x: s + x))
    length = F.sqrt(F.aggregate(added, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(v) >= width) & (F.size(v) % width == 0), F.transform(added, lambda x: F.when(length > 0, x / length).otherwise(0.0)))


def weighted_mean(nodes: DataFrame, key: str, vector: str = "embedding", weight: str = "weight", space: str = "space") -> DataFrame:
    """``key, space, used, pos, value``: of each key the mean of its vectors, by weight (1 where
    missing or not positive), in the space that has most weight, over its length."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    rows = nodes.where(F.size(vector) > 0).select(key, space, w.alias("w"), F.col(vector).cast("array<double>").alias("v"))
    best = rows.groupBy(key, space).agg(F.sum("w").alias("total"), F.count("*").alias("used")).groupBy(key).agg(F.max_by(F.struct(space, "total", "used"), F.struct("total", space)).alias("b"))
    chosen = rows.join(best.select(key, "b.*"), [key, space])
    mean = chosen.select(key, space, "used", "total", "w", F.posexplode("v").alias("pos", "x")).groupBy(key, space, "used", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.first("total")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return mean.select(key, space, "used", "pos", F.when(length > 0, F.col("x") / length).otherwise(0.0).alias("value"))


def seed_profile(exemplars: DataFrame, least: int = 3) -> DataFrame:
    """One row with the rounded mean axes of ``least`` exemplars or more (50 where an axis has
    none), and their number; no row for fewer."""
    means = exemplars.agg(F.count("*").alias("n"), *[F.coalesce(S.half_up(S.clamp(F.avg(a), 0.0, 100.0)), F.lit(50.0)).alias(a) for a in AXES])
    return means.where(F.col("n") >= least)


def prior_targets(described: dict[str, float], nodes: DataFrame, calibration: DataFrame) -> DataFrame:
    """``axis, target``: the described axes, each half and half with the prior of the nearest nodes
    (``code, similarity``), their mean scores weighted by similarity times n up to 25."""
    near = nodes.where("similarity > 0.05").select("code", "similarity")
    w = F.col("similarity") * F.least(F.col("n"), F.lit(25))
    prior = calibration.join(near, "code").withColumn("w", w).where("w > 0").groupBy("category").agg((F.sum(F.col("mean_score") * F.col("w")) / F.sum("w")).alias("prior"))
    base = nodes.sparkSession.createDataFrame([(a, float(described[a])) for a in AXES], "axis string, described double")
    joined = base.join(prior, F.col("axis") == F.col("category"), "left")
    return joined.select("axis", S.half_up(S.clamp(F.coalesce(0.5 * F.col("described") + 0.5 * F.col("prior"), "described"), 20.0, 90.0)).alias("target"))


def rescore_by_neighbours(neighbours: DataFrame, subjects: DataFrame, scores: DataFrame, k: int = 8, least: float = 0.15, most: float = 0.35, boost: float = 0.25, cap: float = 0.9) -> DataFrame:
    """``id``, the six axes and ``confidence`` of the subjects that their grounded neighbours move.

    ``neighbours``: ``query_id, neighbour_id, similarity, rank`` of grounded rows. The first
    ``k`` of ``least`` similarity or more give a mean weighted by similarity; it counts the
    more, up to ``most``, the nearer and the more in agreement they are, and fully from three
    on. Weights of 0.01 or less change nothing.
    """
    near = neighbours.where((F.col("rank") <= k) & (F.col("similarity") >= least)).join(scores.select(F.col("id").alias("neighbour_id"), *[F.coalesce(a, F.lit(0.0)).alias(a) for a in AXES]), "neighbour_id")
    s = F.col("similarity")
    per = near.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("similarity").alias("s"), *[(F.sum(F.col(a) * s) / F.nullif(F.sum(s), F.lit(0.0))).alias(f"__{a}") for a in AXES],
        (sum((F.coalesce(F.stddev_pop(a), F.lit(0.0)) for a in AXES), F.lit(0.0)) / 6).alias("spread"),
    )
    agreement = S.clamp(1 - F.col("spread") / 40, 0.0, 1.0)
    weight = F.least(F.lit(most), F.greatest(F.lit(0.0), most * F.col("s") * agreement * F.least(F.lit(1.0), F.col("n") / 3)))
    joined = subjects.join(per.withColumns({"agreement": agreement, "w": weight}).where("w > 0.01"), F.col("id") == F.col("query_id"))
    w = F.col("w")
    confidence = F.least(F.lit(cap), F.round(S.clamp(F.coalesce("confidence", F.lit(0.5)), 0.0, 1.0) + boost * w * F.col("agreement"), 3))
    return joined.select("id", *[F.round((1 - w) * F.coalesce(a, F.lit(0.0)) + w * F.col(f"__{a}")).cast("int").alias(a) for a in AXES], confidence.alias("confidence"))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, pos, value``: the mean vector of each key over its length."""
    mean = vectors.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return mean.select(key, "pos", F.when(length > 0, F.col("x") / length).otherwise(0.0).alias("value"))
