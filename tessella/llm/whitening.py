"""Whitening of embeddings: principal components by a randomised range finder.

A few passes over all rows multiply the centred covariance with a thin basis, wider than
the components asked for, and each pass gives Rayleigh-Ritz values with their residuals.
Where those do not fall fast enough to reach ``TOLERANCE`` within ``PASSES``, as with a flat
spectrum, the basis is expanded to all dimensions and one more pass settles it.

Entries count as integers, ``floor(64 c) + 1000000``: sums are exact, and rows are centred as
the integers ``n x - sum`` before anything is multiplied, so a mean far from zero costs no
digits. Tasks return one matrix each, whatever their rows; these are added in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, replacing, slices, unused

COMPONENTS = 32
#: Columns of the basis beyond the components, passes over the rows before it is expanded, and
#: the largest residual of a component, as a share of the first eigenvalue.
OVERSAMPLE, PASSES, TOLERANCE = 10, 6, 1e-13
#: An entry as an integer: ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
#: Entries count as this number at most, on either side of zero.
LARGEST = 2.0**53
#: Components whose eigenvalue is below this share of the first have no spread to divide by.
NEGLIGIBLE = 1e-12
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with ``sums`` (Python integers) and ``largest``, the greatest distance of an entry
    from ``SHIFT``; ``values`` and ``vectors`` (a column each) of the components, and the
    covariance's ``trace``. ``passes`` and ``width`` tell how they were found."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    width: int


def usable(vector: Column | str) -> Column:
    """Whether the vector holds numbers only: not null, without null or non-finite entries."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~odd, F.lit(False))


def _whole(c: Column) -> Column:
    return F.floor(F.greatest(F.least(F.lit(float(SCALE)) * c, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(SHIFT)


def integers(vector: Column | str) -> Column:
    """The vector's entries as longs."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v.cast("array<double>"), _whole)


def _offsets(x: pa.Array, n: int, sums: list[int], largest: int) -> np.ndarray:
    """``n x - sums`` of each row, exact: as longs where they fit, else as Python integers."""
    rows = x.flatten().to_numpy().reshape(len(x), len(sums)) - SHIFT
    kind = np.int64 if 2 * n * (largest + 1) < 2**62 else object
    return rows.astype(kind) * n - np.array([s - n * SHIFT for s in sums], kind)


def _centred(x: pa.Array, n: int, sums: list[int], largest: int) -> np.ndarray:
    return _offsets(x, n, sums, largest).astype(float) / n


def _tree(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """One array from the arrays that ``part`` makes of the rows of each task: those of some
    tasks are added in one task, and as many sums as that takes tasks reach the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part(slices(batches, ROWS)).tobytes()], pa.binary())], ["a"])

    def total(found: Iterable[bytes]) -> np.ndarray | None:
        out = None
        for a in found:
            a = np.frombuffer(a)
            out = a if out is None else add(out, a)
        return out

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = total(a.as_py() for batch in batches for a in batch.column(0))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["a"])

    parts = rows.mapInArrow(first, "a binary")
    tasks = max(1, int(len(rows.inputFiles()) ** 0.5))
    return total(sorted(bytes(r.a) for r in parts.repartition(tasks).mapInArrow(second, "a binary").collect()))


def _product(rows: DataFrame, n: int, sums: list[int], largest: int, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``basis``, and the covariance's trace, in one pass over the rows."""
    shape = basis.shape

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, squares = np.zeros(shape), 0.0
        for batch in batches:
            c = _centred(batch.column(0), n, sums, largest)
            out += c.T @ (c @ basis)
            squares += float((c * c).sum())
        return np.append(out.ravel(), squares)

    found = _tree(rows, part, np.add) / n
    return found[:-1].reshape(shape), float(found[-1])


def fit(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 12) -> Whitening | None:
    """The components of all usable vectors of ``df``; None if there are none.

    Null vectors and those with null or non-finite entries are left out, and so are those of
    another length than most have (ties: the longer). Repeated rows count each time. Of
    vectors without spread, as of a single one, there are no components. The driver and each
    task hold two matrices of (dimensions x basis), which grow with the dimensions alone.
    """
    good = df.where(usable(vector)).select(integers(vector).alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["n"]
    rows = materialise(good.where(F.size("x") == d), "vectors")
    x = F.col("c").cast("decimal(20,0)")
    per = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(x).alias("s"), F.max(F.abs(F.col("c") - SHIFT)).alias("m")).collect()
    per = sorted((r.i, int(r.s), r.m) for r in per)
    sums, largest = [s for _, s, _ in per], max(m for *_, m in per)
    k, width = min(components, d), min(d, components + oversample)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((d, width)))[0]
    done, before = 0, np.inf
    while True:
        image, trace = _product(rows, n, sums, largest, basis)
        done += 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residual = np.linalg.norm(image @ turn - basis @ turn * values, axis=0)[:k].max() / max(values[0], np.finfo(float).tiny)
        if basis.shape[1] == d or residual <= tolerance:
            break
        falls = min(1.0, residual / before)
        if done >= passes or (done > 1 and residual * falls ** (passes - done) > tolerance):
            basis = np.linalg.qr(np.hstack([basis, rng.standard_normal((d, d - basis.shape[1]))]))[0]
        else:
            basis, before = np.linalg.qr(image)[0], residual
    kept = int((values[:k] > NEGLIGIBLE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    return Whitening(n, sums, largest, values[:kept], (basis @ turn)[:, :kept], trace, done, basis.shape[1])


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` whose vector is usable and as long as the model's, with ``whitened``, the
    projections on the components over their standard deviations, and ``deviation``, the sum
    over dimensions of the squares of ``n x - sum``: exact, null where a long can't hold it.

    Other columns pass through, those named like the new ones are replaced. Vectors that the
    model was not fitted on are whitened alike.
    """
    n, sums, largest = model.n, model.sums, model.largest
    project = model.vectors / np.sqrt(model.values)
    kind = pa.struct([("whitened", pa.list_(pa.float64())), ("deviation", pa.int64())])

    @F.arrow_udf("struct<whitened:array<double>,deviation:bigint>")
    def judge(x: pa.Array) -> pa.Array:
        high = max(largest, int(np.abs(x.flatten().to_numpy() - SHIFT).max())) if len(x) else largest
        offset = _offsets(x, n, sums, high)
        exact = offset if 4 * len(sums) * n * n * (high + 1) ** 2 < 2**62 else offset.astype(object)
        squares = [int(s) if s < 2**63 else None for s in (exact * exact).sum(axis=1)]
        z = (offset.astype(float) / n) @ project
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(squares, pa.int64())], fields=list(kind))

    df = replacing(df, "whitened", "deviation")
    (found,) = unused(df, "__found")
    good = df.where(usable(vector) & (F.size(vector) == len(sums))).withColumn(found, judge(integers(vector)))
    return good.select(*df.columns, F.col(found)["whitened"].alias("whitened"), F.col(found)["deviation"].alias("deviation"))


def identity_error(whitened: DataFrame, components: int, column: str = "whitened") -> float | None:
    """The largest absolute entry of the column's covariance minus the identity: one pass in
    which pieces of rows are centred on their own mean and their moments merged."""
    k = components

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (n, mean, m2), (m, other, o2) = ((v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)) for v in (a, b))
        if n == 0 or m == 0:
            return b if n == 0 else a
        step = other - mean
        return np.concatenate([[n + m], mean + step * m / (n + m), (m2 + o2 + np.outer(step, step) * n * m / (n + m)).ravel()])

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + k + k * k)
        for batch in batches:
            z = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, k)
            if len(z):
                c = z - z.mean(axis=0)
                out = merge(out, np.concatenate([[len(z)], z.mean(axis=0), (c.T @ c).ravel()]))
        return out

    found = _tree(whitened.select(column), part, merge) if k else None
    if found is None or found[0] == 0:
        return None
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def whitening_digest(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each
    usable vector and component, numbered from 1 by falling eigenvalue."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding")
    model = fit(rows, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = whiten(rows, model)
    error = identity_error(found, len(model.values))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = found.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
