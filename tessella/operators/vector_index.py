"""An index for nearest neighbours by cosine: vectors in lists around centres.

A coarse quantiser, spherical k-means on a bounded sample, gives the centres; each vector goes
to the list of its nearest one. A search compares a query with the vectors of its ``probes``
nearest lists and ranks them by their exact similarity. In an exact search the angles decide
which further lists can hold a better one: no vector of a list lies nearer to a query than the
angle between query and centre less the list's radius.

The index is two tables in one folder, ``vectors`` (by list, in cells of bounded size, so that a
list with very many equal vectors spreads over tasks) and ``lists`` (a row for each list), and
can be kept, opened again and added to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.storage import shared_path
from tessella.operators.vectors import fitting, normalised

#: Lists at most, and rows of the sample for each; both bound what the driver and tasks hold.
MOST_LISTS, SAMPLE_PER_LIST, ROUNDS = 4096, 64, 10
#: Vectors of a cell and queries of a block, about: a task compares one of each at a time.
CELL, BLOCK = 1 << 14, 1 << 12
#: The list of vectors of zeros: they have similarity 0 to all others.
ZEROS = -1
#: Vectors compared with a block of queries at once.
TILE = 2048
#: Entries, about, of a matrix that a task holds: a few of 8 MB each.
ENTRIES = 1 << 20
#: What rounding to six digits and doubles may take from a bound.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """Where the tables lie, the vectors' length, and the lists: number, centre, radius (the
    largest angle of a member) and members of each."""

    path: str
    dim: int
    lists: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    members: np.ndarray

    @property
    def n(self) -> int:
        return int(self.members.sum())


def _rows(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    return fitting(df, vector, dim).select(F.col(id_col).cast("long").alias("i"), normalised(vector).alias("v"))


def _is_zero(v: str) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``list`` and ``angle``, those of the nearest centre; the first of equal ones."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = pa.struct([("list", pa.int32()), ("angle", pa.float64())])

    @F.arrow_udf("struct<list:int,angle:double>")
    def nearest(v: pa.Array) -> pa.Array:
        c = shared.value
        if not len(v):
            return pa.array([], kind)
        x = v.flatten().to_numpy().reshape(len(v), c.shape[1])
        found = [(s.argmax(axis=1), s.max(axis=1)) for s in (x[at : at + TILE] @ c.T for at in range(0, len(x), TILE))]
        lists, best = (np.concatenate(a) for a in zip(*found))
        zero = ~x.any(axis=1)
        lists[zero], best[zero] = ZEROS, 1.0
        return pa.StructArray.from_arrays([pa.array(lists.astype(np.int32)), pa.array(np.arccos(np.clip(best, -1, 1)))], fields=list(kind))

    return rows.withColumn("at", nearest("v")).select("i", "v", "at.list", "at.angle")


def _write(spark: SparkSession, path: str, rows: DataFrame, centres: np.ndarray) -> None:
    """Add placed vectors to the index's folder. Cells are drawn by row, so equal rows spread."""
    counts = rows.groupBy("list").agg(F.count("*").alias("n"))
    cells = counts.select(F.col("list").alias("l"), F.ceil(F.col("n") / CELL).alias("cells"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(cells), F.col("list") == F.col("l"))
    dealt = numbered.select("list", F.pmod(F.xxhash64("row"), F.col("cells")).cast("int").alias("cell"), "i", "v")
    dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "list", "cell").sortWithinPartitions("list", "cell").write.mode("append").parquet(f"{path}/vectors")
    stats = rows.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(ZEROS, [0.0] * centres.shape[1]), *[(i, c.tolist()) for i, c in enumerate(centres)]], "list int, centre array<double>")
    known.join(stats, "list", "left").select("list", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n")).write.mode("append").parquet(f"{path}/lists")


def build_index(base: DataFrame, path: str | None = None, lists: int | None = None, id_col: str = "vec_id", vector: str = "embedding", seed: int = 7) -> VectorIndex | None:
    """Index every row of ``base`` whose vector is as long as most and holds no null; None if there
    are none. ``lists`` defaults to the root of their number, ``MOST_LISTS`` at most.

    Centres are fitted on a sample by row of about ``SAMPLE_PER_LIST`` vectors for each list,
    vectors of zeros left out; a table of up to that many is taken whole.
    """
    spark = base.sparkSession
    sizes = base.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    path = path or shared_path(spark, "index")
    rows = _rows(base, id_col, vector, most.d)
    n = most.n
    k = max(1, min(MOST_LISTS, lists or round(n**0.5)))
    fraction = min(1.0, SAMPLE_PER_LIST * k / n)
    sample = rows.where(~_is_zero("v"))
    sample = sample if fraction == 1.0 else sample.sample(fraction, seed)
    sample = sample.select(array_to_vector("v").alias("features"))
    sample.write.parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    if sample.isEmpty():
        centres = np.zeros((1, most.d))
    else:
        # The root of the number of lists makes the first centres; ML's own rounds do the rest.
        model = KMeans(k=k, distanceMeasure="cosine", maxIter=ROUNDS, seed=seed, initMode="random" if k > 64 else "k-means||").fit(sample) if k > 1 else None
        centres = np.array(model.clusterCenters()) if model else np.array([np.mean([r.features.toArray() for r in sample.collect()], axis=0)])
        lengths = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(lengths > 0, lengths, 1)
    placed = _placed(rows, centres)
    placed.write.parquet(f"{path}/placed")
    _write(spark, path, spark.read.schema(placed.schema).parquet(f"{path}/placed"), centres)
    _drop(spark, f"{path}/placed", f"{path}/sample")
    return open_index(spark, path)


def _drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before; its lists, ``MOST_LISTS`` at most, come to the driver."""
    lists = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.first("centre").alias("centre"), F.max("radius").alias("radius"), F.sum("n").alias("n")).orderBy("list").collect()
    take = lambda name: np.array([r[name] for r in lists])
    return VectorIndex(path, len(lists[0].centre), take("list"), take("centre"), take("radius"), take("n"))


def add_to_index(index: VectorIndex, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """The index with further vectors in its lists; the centres stay."""
    spark = rows.sparkSession
    centres = index.centres[index.lists != ZEROS]
    placed, at = _placed(_rows(rows, id_col, vector, index.dim), centres), shared_path(spark, "placed")
    placed.write.parquet(at)
    _write(spark, index.path, spark.read.schema(placed.schema).parquet(at), centres)
    _drop(spark, at)
    return open_index(spark, index.path)


def _rows_at_once(width: int) -> int:
    return max(1, ENTRIES // max(1, width))


def _list_array(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """An array of lists from the sizes and joined entries of its parts."""
    sizes, entries = (np.concatenate(a) for a in zip(*found))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(entries.astype(np.int32)))


def _nearest_lists(index: VectorIndex, probes: int) -> Column:
    """Of a query's vector ``v`` the ``probes`` nearest lists that have members."""
    lists, centres = index.lists[index.members > 0], index.centres[index.members > 0]

    @F.arrow_udf("array<int>")
    def nearest(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        x = v.flatten().to_numpy().reshape(len(v), index.dim)
        found, step = [], _rows_at_once(len(lists))
        for at in range(0, len(x), step):
            order = np.argsort(-(x[at : at + step] @ centres.T), axis=1, kind="stable")[:, :probes]
            found.append((np.full(len(order), order.shape[1]), lists[order].ravel()))
        return _list_array(found)

    return nearest("v")


def _further_lists(index: VectorIndex, probes: int) -> Column:
    """Of a query's ``v`` and ``kth``, its worst similarity so far (null for too few), the lists
    after the first ``probes`` that may hold a vector as near."""
    has = index.members > 0
    lists, centres, radius = index.lists[has], index.centres[has], index.radius[has]

    @F.arrow_udf("array<int>")
    def further(v: pa.Array, kth: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        x = v.flatten().to_numpy().reshape(len(v), index.dim)
        least = np.array([-2.0 if t is None else t for t in kth.to_pylist()])
        found, step = [], _rows_at_once(len(lists))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            s = part @ centres.T
            bound = np.cos(np.maximum(0.0, np.arccos(np.clip(s, -1, 1)) - radius - 1e-7))
            bound[:, lists == ZEROS] = 0.0
            bound[~part.any(axis=1)] = 0.0
            may = bound + SLACK >= least[at : at + step, None]
            np.put_along_axis(may, np.argsort(-s, axis=1, kind="stable")[:, :probes], False, axis=1)
            found.append((may.sum(axis=1), lists[np.nonzero(may)[1]]))
        return _list_array(found)

    return further("v", "kth")


def _best(own: np.ndarray, matrix: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, neighbour and similarity of the best ``k`` of ``x`` for each row of ``matrix``."""
    top_s, top_i = np.empty((len(own), 0)), np.empty((len(own), 0), np.int64)
    for at in range(0, len(ids), TILE):
        i = ids[at : at + TILE]
        s = np.round(matrix @ x[at : at + TILE].T, 6)
        s[own[:, None] == i[None, :]] = -np.inf
        s, j = np.hstack([top_s, s]), np.hstack([top_i, np.broadcast_to(i, s.shape)])
        keep = np.lexsort((j, -s), axis=1)[:, :k]
        top_s, top_i = np.take_along_axis(s, keep, 1), np.take_along_axis(j, keep, 1)
    found = np.isfinite(top_s.ravel())
    return np.repeat(own, top_s.shape[1])[found], top_i.ravel()[found], top_s.ravel()[found]


def _compare(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, neighbour_id, similarity``: of each query (``i, v, lists``) the best ``k`` of each
    cell of its lists. Cells and blocks of queries meet by list; both are bounded."""
    spark = asked.sparkSession
    pairs = asked.select(F.col("i").alias("query_id"), "v", F.explode("lists").alias("list"))
    # A row for each list, of which there are few.
    wanted = pairs.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    vectors = spark.read.parquet(f"{index.path}/vectors")
    cells = vectors.groupBy("list").agg((F.max("cell") + 1).alias("cells"))
    shape = wanted.join(cells, "list")
    dealt = pairs.join(F.broadcast(shape), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("query_id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "block")
    base = vectors.join(F.broadcast(wanted), "list").select("list", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "i", "v")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        own, ids = left.column("query_id").to_numpy(), right.column("i").to_numpy()
        matrix, x = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, index.dim) for t in (left, right))
        rows = _rows_at_once(min(TILE, max(1, len(ids))))
        found = [_best(own[at : at + rows], matrix[at : at + rows], ids, x, k) for at in range(0, len(own), rows)]
        columns = [np.concatenate(a) for a in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "neighbour_id", "similarity"), columns)))

    keys = ["list", "cell", "block"]
    return dealt.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(best, "query_id long, neighbour_id long, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_index(index: VectorIndex | None, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, neighbour_id, similarity, rank``, as ``vectors.knn_cosine`` gives them: of each
    query the ``k`` most similar vectors in its ``probes`` nearest lists, itself left out; ties by
    id. All lists as ``probes`` make it exact, and so does ``exact``, which after the first
    lists looks into just those whose bound allows a better vector.

    Query ids are distinct. Queries of another length than the index's, null ones and those that
    hold a null find nothing.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, neighbour_id long, similarity double, rank int")
    at = shared_path(spark, "asked")
    _rows(queries, id_col, vector, index.dim).write.parquet(at)
    asked = spark.read.schema("i long, v array<double>").parquet(at)
    found = _ranked(_compare(index, asked.withColumn("lists", _nearest_lists(index, probes)), k), k)
    if not exact or probes >= int((index.members > 0).sum()):
        return found
    kept = shared_path(spark, "found")
    found.write.parquet(kept)
    found = spark.read.schema(found.schema).parquet(kept)
    worst = found.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("similarity").alias("kth"))
    left = asked.join(worst, F.col("i") == F.col("q"), "left").select("i", "v", "kth")
    more = _compare(index, left.select("i", "v", _further_lists(index, probes).alias("lists")).where(F.size("lists") > 0), k)
    return _ranked(found.drop("rank").unionByName(more), k)


def probes_for(index: VectorIndex, queries: DataFrame, target: float = 0.9, k: int = 10, sample: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """The least number of probes at which searches like ``queries`` find ``target`` of the true ``k``
    neighbours: measured by exact searches of ``sample`` queries at most, drawn by hash, whose
    neighbours' lists come to the driver."""
    some = fitting(queries, vector, index.dim).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    asked = {r.i: np.array(r.v) for r in _rows(some, id_col, vector, index.dim).collect()}
    true = search_index(index, some, k, exact=True, id_col=id_col, vector=vector).select("query_id", "neighbour_id")
    homes = some.sparkSession.read.parquet(f"{index.path}/vectors").select(F.col("i").alias("neighbour_id"), "list")
    has = index.members > 0
    lists, centres = index.lists[has], index.centres[has]
    place = {q: {int(n): at for at, n in enumerate(lists[np.argsort(-(centres @ v), kind="stable")])} for q, v in asked.items()}
    needed = sorted(place[r.query_id][r.list] + 1 for r in true.join(homes, "neighbour_id").collect())
    return needed[max(0, int(np.ceil(target * len(needed))) - 1)] if needed else 1
