"""Values at the edges of bins and buckets, and sums that don't depend on the order of rows."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import functions as F

from tessella.functions.scalars import AXES, exact_mean
from tessella.operators import audience, audio, dashboards, profiles
from tessella.plans import reports

TARGET = dict.fromkeys(AXES, 50.0)
#: Their means are 50 and 48.2; sums of doubles in most of their orders are less.
FIFTY = (40.69, 54.98, 53.91, 40.16, 60.26)
TIED = (93.96, 43.75, 46.68, 20.38, 36.23)


def _off_by(spark, *distances):
    """Users whose first axis lies that far from the target, a six-hundredth of it from a full fit."""
    return spark.createDataFrame([(i, 50.0 - d, *[50.0] * 5) for i, d in enumerate(distances)], "user_id long, " + ", ".join(f"{a} double" for a in AXES))


def test_a_fit_just_below_a_bucket_stays_below(spark):
    # 98.99999 and 99 of a hundred.
    found = audience.fit_histogram(_off_by(spark, 6.00006, 6.0), TARGET)
    assert {r.bucket: r.users for r in found.collect()} == {99: 1, 100: 1}


def test_reach_curve_counts_no_fit_just_below_a_threshold(spark):
    found = audience.reach_curve(audience.fit_histogram(_off_by(spark, 12.0, 6.00006, 6.0), TARGET))
    assert {r.threshold: r.reach for r in found.collect()} == {99: 3, 100: 1}


def _in_all_orders(spark, values, kind):
    """Events of users that have the same values in all orders."""
    rows = [(u, kind, v) for u, p in enumerate(permutations(values)) for v in p]
    return spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1)


def test_bins_do_not_depend_on_the_order_of_sums(spark):
    found = profiles.axis_histogram(profiles.axis_profiles(_in_all_orders(spark, FIFTY, "error")))
    assert [(r.axis, r.bin, r.n) for r in found.where("axis in ('artistic', 'emotional')").orderBy("axis").collect()] == [("artistic", 5, 120), ("emotional", 5, 120)]


def test_means_of_other_numbers_are_those_of_doubles(spark):
    rows = [("a", 1 / 3), ("a", 2 / 3), ("b", 1e300), ("b", None), ("c", float("inf")), ("c", 1.0), ("d", None), ("e", 0.25), ("e", None)]
    found = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(exact_mean("v").alias("m"))
    assert {r.k: r.m for r in found.collect()} == {"a": 0.5, "b": 1e300, "c": float("inf"), "d": None, "e": 0.25}


def test_bins_of_a_population_do_not_depend_on_the_order_of_sums(spark):
    found = dashboards.population(reports._profile_of(_in_all_orders(spark, FIFTY, "error"), "user_id"))
    assert {r.axis: (r.mean, r.bins) for r in found.collect()}["emotional"] == (50.0, "0,0,0,0,0,120,0,0,0,0")


def test_tied_tracks_stand_alike_in_a_market(spark, tmp_path):
    _in_all_orders(spark, TIED, "view").write.parquet(f"{tmp_path}/events.parquet")
    found = reports.QUERIES["market_metrics"](spark, str(tmp_path)).groupBy("z", "percentile", "distinctiveness", "basis").count().collect()
    assert [tuple(r) for r in found] == [(0.41, 66, 21, "published", 120)]


def test_window_means_follow_the_order_of_frames_in_any_partitions(spark):
    values, rows = (0.1, 0.2, 0.3, 0.7, 1 / 3), []
    for k in range(40):
        rows += [(k, 5 * k + i, f"2024-01-01 00:00:0{i % 4}", v, v * 7, [v, v / 3]) for i, v in enumerate(values[k % 5 :] + values[: k % 5])]
    df = spark.createDataFrame(rows, "k long, i long, at string, rms double, centroid_hz double, chroma array<double>").withColumn("at", F.col("at").cast("timestamp"))
    expected = {}
    for k in range(40):
        own, total = [r for r in rows if r[0] == k], lambda xs: reduce(float.__add__, xs, 0.0)
        expected[k] = (5, total([r[3] for r in own]) / 5, total([r[4] for r in own]) / 5, [total([r[5][p] for r in own]) / 5 for p in (0, 1)])
    for spread in (df.coalesce(1), df.repartition(7, "i"), df.orderBy(F.desc("i"))):
        found = {r.k: (r.n, r.rms, r.centroid_hz, r.chroma) for r in audio.window_features(spread, "k", "at", order="i").collect()}
        assert found == expected


def test_ordered_windows_equal_the_others(spark):
    rows = [(1, 1, 0.5, [1.0, 2.0]), (1, 2, 0.25, [1.0]), (2, 3, 0.5, []), (3, 4, None, None), (4, 5, 1.0, [None, 1.0])]
    df = spark.createDataFrame(rows, "k long, i long, rms double, chroma array<double>").select("*", F.lit(8.0).alias("centroid_hz"), F.timestamp_seconds(F.lit(0)).alias("at"))
    plain, ordered = (sorted(tuple(r) for r in audio.window_features(df, "k", "at", order=o).collect()) for o in (None, "i"))
    assert plain == ordered and [r[-1] for r in plain] == [[1.0, 1.0], [], [], [None, 1.0]]
