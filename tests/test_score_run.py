"""Staged scoring: stages, replays and a crash after each sink."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import algebra
from tessella.operators.score_run import AXES, TABLES, ScoreStore, run_scores

AT = datetime(2024, 5, 1)
TASKS = "task_id long, identifier string, report_type string, codes array<string>, confidence double, signals int, label string, seen_at timestamp"


def tasks(spark, *rows):
    return spark.createDataFrame([(i, who, "ctv", codes, c, n, None, AT) for i, who, codes, c, n in rows], TASKS)


def nodes(spark):
    return spark.createDataFrame([("a", "A", False), ("off", "Off", True), ("poi.x", "City Hospital", None)], "code string, label string, suppressed boolean")


def scorer(asked):
    """Ten for each code, and a tenth of what was known."""
    return asked.withColumns({a: F.size("codes") * 10.0 + i + F.coalesce(F.col(f"prior_{a}") / 10, F.lit(0.0)) for i, a in enumerate(AXES)})


def contents(store):
    return {t: sorted((tuple(r) for r in store.read(t).collect()), key=str) for t in TABLES}


def first(spark):
    return tasks(spark, (1, "u", ["a", "b"], 0.8, 3), (2, "v", ["b", "a"], None, 2), (3, "w", ["a", "off", "poi.x"], 0.6, 1), (4, "u", ["z"], 0.9, 1), (5, "e", None, 0.5, None), (6, None, ["a"], 0.5, 1))


def test_stages(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path))
    out = {r.task_id: r for r in run_scores(store, "one", first(spark), nodes(spark), scorer).collect()}
    assert {i: r.status for i, r in out.items()} == {1: "scored", 2: "scored", 3: "scored", 4: "deferred", 5: "scored"}
    assert {i: r.from_cache for i, r in out.items()} == {1: False, 2: True, 3: False, 4: None, 5: False} and out[3].suppressed == 2
    found = {r.identifier: r for r in store.read("identifiers").collect()}
    assert (found["u"].emotional, found["v"].emotional, found["w"].emotional, found["e"].emotional) == (20.0, 20.0, 30.0, 0.0)
    assert found["v"].confidence == 0.5 and found["u"].observations == 3 and found["e"].observations == 0 and found["e"].codes == []
    assert {(r.code, r.weight) for r in store.read("source_tags").where(F.col("source_id") == found["w"].source_id).collect()} == {("a", 0.6)}
    prior = {(r.code, r.category): (r.n, r.mean) for r in store.read("calibration").collect()}
    assert prior["a", "emotional"] == (2, 25.0) and prior["b", "emotional"] == (1, 20.0) and ("off", "emotional") not in prior
    # The next run: known codes, a hit, a miss with priors, and the task that was deferred.
    more = tasks(spark, (4, "u", ["z"], 0.9, 1), (7, "v", ["a"], 0.7, 5), (8, "x", ["a", "b"], 0.7, 5), (9, "y", ["a"], 0.7, 5))
    out = {r.task_id: r for r in run_scores(store, "two", more, nodes(spark), scorer).collect()}
    assert {i: (r.status, r.from_cache) for i, r in out.items()} == {4: ("scored", False), 7: ("unchanged", None), 8: ("scored", True), 9: ("scored", False)}
    found = {r.identifier: r for r in store.read("identifiers").collect()}
    assert found["y"].emotional == pytest.approx(12.5) and found["u"].codes == ["a", "b", "z"] and found["u"].observations == 4 and found["v"].observations == 2
    assert {(r.code, r.category): r.n for r in store.read("calibration").collect()}["a", "emotional"] == 3
    assert store.read("analyses").count() == 7


def test_normalised_before_cached(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path))
    damped = lambda df: algebra.damp_speech(df, 0.4)
    run_scores(store, "one", first(spark).where("task_id = 1"), nodes(spark), scorer, damped)
    raw = spark.createDataFrame([tuple(20.0 + i for i in range(6))], ", ".join(f"{a} double" for a in AXES))
    expected = tuple(algebra.damp_speech(raw, 0.4).select(*AXES).first())
    assert tuple(store.read("cache").select(*AXES).first()) == expected == tuple(store.read("identifiers").select(*AXES).first())


@pytest.mark.parametrize("sink", ["calibration", "identifiers", "outcomes"])
def test_a_crash_after_any_sink_changes_nothing(spark, tmp_path, sink):
    whole, broken = ScoreStore(spark, str(tmp_path / "a")), ScoreStore(spark, str(tmp_path / "b"))
    more = tasks(spark, (7, "v", ["a", "c"], 0.7, 5), (8, "x", ["a", "b"], 0.7, 5))
    for store in (whole, broken):
        run_scores(store, "one", first(spark), nodes(spark), scorer)
    before = contents(broken)

    def crash(table):
        if table == sink:
            raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        run_scores(broken, "two", more, nodes(spark), scorer, after=crash)
    assert broken.committed() == ["one"] and contents(broken) == before
    for store in (whole, broken):
        for _ in range(2):  # The second time it is committed already.
            run_scores(store, "two", more, nodes(spark), scorer)
    assert contents(broken) == contents(whole) and broken.committed() == ["one", "two"]


def test_compaction_keeps_all_rows(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path))
    run_scores(store, "one", first(spark), nodes(spark), scorer)
    before = contents(store)
    store.compact()
    assert contents(store) == before
    run_scores(store, "two", tasks(spark, (9, "y", ["a"], 0.7, 5)), nodes(spark), scorer)
    assert len(contents(store)["identifiers"]) == len(before["identifiers"]) + 1
    assert run_scores(store, "one", first(spark), nodes(spark), scorer).count() == 5 and S.AXES
