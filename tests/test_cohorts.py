"""Clusters, impact and settings on small literal tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import documents
from tessella.functions.scalars import AXES
from tessella.operators import algebra, cohorts, control, dashboards

NAMES = ", ".join(f"{a} double" for a in AXES)


def test_clusters_split_the_largest_group(spark):
    rng = np.random.default_rng(3)
    centres = {"a": [(20,) * 6, (80,) * 6], "b": [(50,) * 6]}
    rows, kind = [], {}
    for i in range(60):
        sign = "a" if i < 45 else "b"
        k = i % len(centres[sign])
        kind[i] = (sign, k)
        spread = 2.0 if sign == "a" else 0.0
        rows.append((i, sign, *(float(x) for x in np.array(centres[sign][k]) + rng.normal(0, spread, 6))))
    points = spark.createDataFrame(rows, f"id long, signature string, {NAMES}")
    found = {r.id: r.cohort for r in cohorts.cluster_signals(points, 3).collect()}
    assert {c: {kind[i] for i in found if found[i] == c} for c in range(3)} == {0: {("a", 0)}, 1: {("a", 1)}, 2: {("b", 0)}}
    # Groups without variation are never cut, whatever the budget.
    assert {r.cohort for r in cohorts.cluster_signals(points.where("signature = 'b'"), 5).collect()} == {0}
    assert cohorts.cluster_signals(points.limit(0), 5).count() == 0


def test_impact_of_a_site_tag(spark):
    rng = np.random.default_rng(5)
    axes = rng.uniform(0, 100, (60, 6))
    axes[:, 5] = 40.0
    records = spark.createDataFrame([(f"d{i}", *map(float, v)) for i, v in enumerate(axes)], f"device_id string, {NAMES}")
    events = [(m, float(3 + 0.2 * v[0]), f"d{i}") for i, v in enumerate(axes) for m in (("ctr", "reach") if i < 30 else ("ctr",))]
    table = spark.createDataFrame([*events, ("ctr", None, "d1"), (None, 1.0, "d1"), ("ctr", 1.0, None)], "metric string, value double, device_id string")
    metric, drivers, predicted = cohorts.tag_impact(table, records, records.withColumnRenamed("device_id", "id"), draws=40, penalty=1e-6)
    found = {r.term: r for r in drivers.collect()}
    assert metric == "ctr" and AXES[5] not in found and abs(found[AXES[0]].per_10 - 2.0) < 0.01 and found[AXES[0]].conclusive
    rows = {r.id: r for r in predicted.collect()}
    assert all(abs(rows[f"d{i}"].predicted - (3 + 0.2 * v[0])) < 0.05 for i, v in enumerate(axes))
    few = cohorts.tag_impact(table.where("device_id = 'd1'"), records, records.withColumnRenamed("device_id", "id"))
    assert few[0] == "ctr" and few[1].count() == few[2].count() == 0
    assert cohorts.tag_impact(table.limit(0), records, records.withColumnRenamed("device_id", "id"))[0] is None


def test_text_that_is_no_json(spark):
    rows = spark.createDataFrame([(1, None, "[1, 2]"), (2, "{}", "[]"), (3, '["a", {"label": "l"}]', "[1, null]"), (4, "x", "x")], "id int, tags string, v string")
    found = rows.select("id", F.size(documents.elements("tags")).alias("n"), documents.parse_vector("v").alias("v")).orderBy("id").collect()
    assert [r.n for r in found] == [0, 0, 2, 0] and [r.v for r in found] == [[1.0, 2.0], None, None, None]


def test_settings_keep_their_bounds(spark):
    rows = spark.createDataFrame([("number", "5", '{"max": 4}'), ("number", '"5"', None), ("boolean", "1", None), ("enum", '"b"', '{"options": ["a"]}'), ("enum", '"b"', None), ("number", "-1.5", '{"min": ""}')], "value_type string, value string, bounds string")
    assert [r.p for r in rows.select(control.setting_problem().alias("p")).collect()] == ["above max", "expects a number", "expects a boolean", "not an allowed option", None, None]


def test_empty_reports(spark):
    empty = spark.createDataFrame([], f"user_id long, {NAMES}, confidence double, created_at timestamp, members long")
    assert algebra.auto_tune(empty).count() == 0 and algebra.meta_fingerprint(empty).count() == 0
    assert algebra.user_fingerprints(empty, "2024-01-01 00:00:00").count() == 0
    assert {r.n for r in dashboards.population(empty).collect()} == {0}
