"""Each registered query of the analytics library against its SQL."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import assert_same

from tessella.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


def test_ridge_recovers_a_plane(spark):
    from pyspark.sql import functions as F

    from tessella.operators.learning import ridge

    rows = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    rows = rows.withColumn("y", 3 + 2 * F.col("a") - F.col("b"))
    found = {r.term: r.coefficient for r in ridge(rows, ["a", "b"], "y", 0.0).collect()}
    assert found == pytest.approx({"intercept": 3.0, "a": 2.0, "b": -1.0})
    flat = rows.withColumn("b", F.col("a"))
    assert ridge(flat, ["a", "b"], "y", 0.0).count() == 0
    assert ridge(rows.limit(0), ["a"], "y").count() == 0


def test_kmeans_labels_every_vector(spark):
    from tessella.plans.queries import load

    found = QUERIES["kmeans_cohorts"](spark, SMALL)
    assert found.count() == load(spark, SMALL, "embeddings").count()
    assert 1 < found.select("cohort").distinct().count() <= 8


def test_kmeans_equals_a_plain_run(spark):
    """Farthest-point seeds from the first vector, at most fifteen rounds."""
    import numpy as np

    from tessella.operators.learning import kmeans_cohorts

    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(c, 0.35, (25, 3)) for c in ((4, 0, 0), (0, 4, 0), (0, 0, 4), (3, 3, 0))])
    far = lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b))
    seeds = [0]
    while len(seeds) < 4:
        near = [min(far(p, points[s]) for s in seeds) for p in points]
        seeds.append(int(np.argmax(near)))
    centres = points[seeds]
    for _ in range(15):
        own = np.array([int(np.argmin([far(p, c) for c in centres])) for p in points])
        centres = np.array([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(4)])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    assert [r.cohort for r in kmeans_cohorts(rows, 4).orderBy("vec_id").collect()] == own.tolist()
    assert kmeans_cohorts(rows.limit(0), 4).count() == 0 and kmeans_cohorts(rows.limit(2), 4).count() == 2


def test_bootstrap_intervals_hold_the_truth(spark):
    import numpy as np

    from tessella.operators.learning import bootstrap

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 2))
    y = 3 + 2 * x[:, 0] + rng.normal(0, 0.5, 400)
    rows = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    found = {r.term: r for r in bootstrap(rows, ["a", "b"], "y", "id", 1e-4).collect()}
    assert found["a"].low < 2 < found["a"].high and found["a"].conclusive and found["a"].high - found["a"].low < 0.2
    assert not found["b"].conclusive and found["b"].low < 0 < found["b"].high and found["a"].r2 > 0.9 and found["a"].n == 400
    assert bootstrap(rows.withColumn("b", rows.a), ["a", "b"], "y", "id", 0.0).count() == 0


def test_neighbours_of_odd_vectors(spark):
    from tessella.operators.vectors import knn_cosine

    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0]), (7, [0.0, 1.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): r.neighbour_id for r in knn_cosine(base, base.where("vec_id in (1, 4, 7)"), 2).collect()}
    assert found == {(1, 1): 2, (1, 2): 3, (7, 1): 2, (7, 2): 1}
    assert knn_cosine(base, base.limit(0)).count() == 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "fit", "lead"]
    assert 0 < __spark_entry__.entry(spark).count() <= 20
