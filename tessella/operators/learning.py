"""Ridge regression from moments, bootstrap intervals, and k-means cohorts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.storage import written


def cross_moments(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: ``n`` and the sums of all products of 1, the features and the target, as
    ``s_<a>_<b>``; rows with a null are left out. One aggregation, whatever the size."""
    whole = df.dropna(subset=[*features, target])
    names = ["one", *features, target]
    of = {"one": F.lit(1.0), **{c: F.col(c) for c in (*features, target)}}
    sums = [F.sum(of[a] * of[b]).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return whole.agg(F.count("*").alias("n"), *sums)


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """``term, coefficient`` (``intercept`` first): least squares with ``penalty * n`` on the
    squared coefficients but the intercept's; no rows for a singular system or no data."""
    m = cross_moments(df, features, target).first()
    schema = "term string, coefficient double"
    if not m.n:
        return df.sparkSession.createDataFrame([], schema)
    names = ["one", *features]
    at = lambda a, b: m[f"s_{a}_{b}"] if f"s_{a}_{b}" in m else m[f"s_{b}_{a}"]
    x = np.array([[at(a, b) for b in names] for a in names]) + np.diag([0.0] + [penalty * m.n] * len(features))
    y = np.array([at(a, target) for a in names])
    if np.linalg.matrix_rank(x, tol=1e-9 * np.abs(x).max()) < len(names):
        return df.sparkSession.createDataFrame([], schema)
    solved = np.linalg.solve(x, y)
    return df.sparkSession.createDataFrame([("intercept" if t == "one" else t, float(c)) for t, c in zip(names, solved)], schema)


def bootstrap(df: DataFrame, features: list[str], target: str, key: str, penalty: float = 1e-2, draws: int = 200, seed: int = 42) -> DataFrame:
    """``term, coefficient, low, high, conclusive, r2, n``: ridge coefficients with intervals from
    the 2.5th and 97.5th percentile, by nearest rank, of ``draws`` resamples.

    A resample weighs each row by a Poisson number of mean 1, made of a hash of ``key``, so no
    task and not the driver holds all rows: one aggregate gives the moments of all draws, and
    small systems are solved. Fewer than ten solved draws give no interval; an interval that
    spans zero is not conclusive. No rows for a singular system or no data.
    """
    whole = df.dropna(subset=[*features, target])
    names = ["one", *features, target]
    of = {"one": F.lit(1.0), **{c: F.col(c).cast("double") for c in (*features, target)}}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "draw", key), 11) / F.lit(float(1 << 53))
    steps, term, total = [], float(np.exp(-1.0)), 0.0
    for i in range(12):
        total += term
        steps.append(F.when(unit >= total, 1).otherwise(0))
        term /= i + 1
    weighed = whole.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1)))).withColumn("w", F.when(F.col("draw") < 0, 1).otherwise(sum(steps, F.lit(0))))
    sums = [F.sum(F.col("w") * of[a] * of[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    rows = weighed.groupBy("draw").agg(*sums).orderBy("draw").collect()  # one for each draw
    schema = "term string, coefficient double, low double, high double, conclusive boolean, r2 double, n long"
    spark, terms = df.sparkSession, ["intercept", *features]

    def solve(row):
        m = {p: row[f"s{i}"] for i, p in enumerate(pairs)}
        at = lambda a, b: m[(a, b)] if (a, b) in m else m[(b, a)]
        n = at("one", "one")
        x = np.array([[at(a, b) for b in names[:-1]] for a in names[:-1]]) + np.diag([0.0] + [penalty * n] * len(features))
        y = np.array([at(a, target) for a in names[:-1]])
        if not n or np.linalg.matrix_rank(x, tol=1e-9 * np.abs(x).max()) < len(x):
            return None, m
        return np.linalg.solve(x, y), m

    if not rows or rows[0].draw != -1:
        return spark.createDataFrame([], schema)
    beta, m = solve(rows[0])
    if beta is None:
        return spark.createDataFrame([], schema)
    at = lambda a, b: m[(a, b)] if (a, b) in m else m[(b, a)]
    n = at("one", "one")
    gram = np.array([[at(a, b) for b in names[:-1]] for a in names[:-1]])
    y = np.array([at(a, target) for a in names[:-1]])
    left, spread = at(target, target) - 2 * beta @ y + beta @ gram @ beta, at(target, target) - y[0] * y[0] / n
    solved = np.array([b for b, _ in map(solve, rows[1:]) if b is not None])
    out = []
    for j, name in enumerate(terms):
        low = high = None
        if len(solved) >= 10:
            s = np.sort(solved[:, j])
            low, high = (float(s[min(len(s) - 1, int(np.floor(q * (len(s) - 1) + 0.5)))]) for q in (0.025, 0.975))
        out.append((name, float(beta[j]), low, high, low is not None and not low <= 0 <= high, float(1 - left / spread) if spread > 0 else 0.0, int(n)))
    return spark.createDataFrame(out, schema)


def suggest_k(n: int, most: int = 8) -> int:
    """Clusters for ``n`` rows: the root of half of them, from 2 to ``most``; 1 for fewer than 4."""
    return 1 if n < 4 else max(2, min(most, int(np.floor(np.sqrt(n / 2) + 0.5))))


def _distance(vector: str, centre: np.ndarray) -> Column:
    """One less the cosine similarity; 1 for a vector of zeros."""
    length = float(np.sqrt((centre * centre).sum()))
    unit = F.array(*[F.lit(float(x / length)) if length else F.lit(0.0) for x in centre])
    v = F.col(vector)
    dot = F.aggregate(F.zip_with(v, unit, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(own > 0, 1 - dot / own).otherwise(1.0)


def kmeans_cohorts(vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", most_rounds: int = 15) -> DataFrame:
    """``id, cohort``: k-means by cosine distance from farthest-point seeds.

    The first seed is the vector of the least id, each next one that farthest from the seeds
    so far (ties by id); a vector belongs to the first of its nearest centres, and a centre
    without any stays. Each round is one aggregate; k centres come to the driver. Null vectors
    and those that hold a null are left out; fewer vectors than ``k`` make as many cohorts.
    """
    rows = vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(id_col, F.col(vector).cast("array<double>").alias("v"))
    rows = written(rows, "vectors")
    first = rows.agg(F.min_by("v", id_col).alias("v"), F.count("*").alias("n")).first()
    if not first.n:
        return rows.select(id_col, F.lit(0).alias("cohort"))
    centres = [np.array(first.v)]
    while len(centres) < min(k, first.n):
        nearest = F.least(*[F.round(_distance("v", c), 9) for c in centres]) if len(centres) > 1 else F.round(_distance("v", centres[0]), 9)
        centres.append(np.array(rows.agg(F.min_by("v", F.struct(-nearest, id_col))).first()[0]))

    def assigned(now: list[np.ndarray]) -> Column:
        far = [F.round(_distance("v", c), 9) for c in now]
        least = F.least(*far) if len(far) > 1 else far[0]
        return F.coalesce(*[F.when(d == least, i) for i, d in enumerate(far)])

    before = None
    for _ in range(most_rounds):
        named = rows.select(assigned(centres).alias("c"), F.col(id_col), "v")
        state = named.agg(F.sum(F.xxhash64(id_col, "c").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
        means = named.select("c", F.posexplode("v").alias("p", "x")).groupBy("c", "p").agg(F.avg("x").alias("x"))
        for r in means.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v")).collect():
            centres[r.c] = np.array(r.v)
    return rows.select(id_col, assigned(centres).alias("cohort"))


def predicted_outcomes(records: DataFrame, outcomes: DataFrame, axes: list[str], key: str = "user_id", least: int = 24, most: int = 25, draws: int = 200, penalty: float = 1e-2) -> tuple[DataFrame, DataFrame]:
    """Drivers (``term, per_10, low, high, conclusive``; conclusive ones first, then by size) of the
    mean ``value`` of each key's ``outcomes``, and the ``most`` records with the highest
    prediction (``key, predicted``). Neither for fewer than ``least`` matched keys."""
    per = outcomes.where("value is not null").groupBy(key).agg(F.avg("value").alias("__y"))
    fitted = written(records.join(per, key).select(key, "__y", *[(F.coalesce(a, F.lit(0.0)) / 100).alias(a) for a in axes]), "outcomes")
    schema = "term string, per_10 double, low double, high double, conclusive boolean"
    fit = {r.term: r for r in bootstrap(fitted, axes, "__y", key, penalty, draws).collect()} if fitted.count() >= least else {}
    spark = records.sparkSession
    if not fit:
        return spark.createDataFrame([], schema), records.select(key, F.lit(0.0).alias("predicted")).limit(0)
    tenth = lambda x: None if x is None else x / 10
    rows = sorted(((a, tenth(fit[a].coefficient), tenth(fit[a].low), tenth(fit[a].high), fit[a].conclusive) for a in axes), key=lambda r: (not r[4], -abs(r[1]), r[0]))
    score = F.lit(fit["intercept"].coefficient) + sum((fit[a].coefficient * F.coalesce(F.col(a), F.lit(0.0)) / 100 for a in axes), F.lit(0.0))
    return spark.createDataFrame(rows, schema), records.select(key, score.alias("predicted")).orderBy(F.desc("predicted"), key).limit(most)
