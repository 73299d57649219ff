"""Live streams over several deliveries with kept checkpoints."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tessella.plans.catalogues import beacon_rows, site_tags
from tessella.sources import beacons
from tessella.streaming import ingest, live

BEGIN = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"


def deliver(spark, folder, calls):
    rows = [(i, BEGIN + timedelta(seconds=t), u, float(t)) for i, u, t in calls]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def plain(calls, gap):
    """(event, throttled) of calls in order; one score a user and gap."""
    last, out = {}, {}
    for i, u, t in sorted(calls, key=lambda c: (c[2], c[0])):
        out[i] = u in last and t - last[u] < gap
        if not out[i]:
            last[u] = t
    return out


def scored(rows):
    return rows.withColumn("score", F.col("value") * 2)


def keys_in_state(spark, state):
    return spark.read.format("statestore").option("stateVarName", "last").load(state).count()


def test_one_score_per_user_and_window_over_deliveries(spark, tmp_path):
    rng = random.Random(8)
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [(i, rng.randrange(6), rng.randrange(0, 300)) for i in range(120)]
    second = [(1000 + i, rng.randrange(6), rng.randrange(300, 600)) for i in range(120)]
    run = lambda: live.live_scores(ingest.event_stream(spark, folder), "user_id", "event_id", 5, scored, path, state).collect()
    deliver(spark, folder, first)
    assert {r.event_id: r.throttled for r in run()} == plain(first, 4)
    deliver(spark, folder, second)
    for _ in range(2):  # A third call finds nothing new.
        found = run()
        assert {r.event_id: r.throttled for r in found} == plain(first + second, 4)
    assert all((r.score is None) == r.throttled and (r.retry_in_ms is None) != r.throttled for r in found)
    by_user = {u: sorted(r.at for r in found if r.user_id == u and not r.throttled) for u in range(6)}
    assert all(b - a >= 4_000_000 for times in by_user.values() for a, b in zip(times, times[1:]))
    assert sum(r.turned_down or 0 for r in found) <= sum(r.throttled for r in found)


def test_state_of_old_windows_goes(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: live.live_scores(ingest.event_stream(spark, folder), "user_id", "event_id", 5, scored, path, state, late="10 seconds").count()
    deliver(spark, folder, [(i, i, i % 3) for i in range(40)])
    assert run() == 40 and keys_in_state(spark, state) == 40
    deliver(spark, folder, [(100, 999, 3600)])
    assert run() == 41 and keys_in_state(spark, state) == 1
    # Behind the watermark by then: left out. A user whose state has gone is scored anew.
    deliver(spark, folder, [(101, 3, 2), (102, 4, 3595)])
    assert run() == 42


def test_the_clock_of_the_machine(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    deliver(spark, folder, [(i, i % 2, i * 100) for i in range(10)])
    run = lambda: live.live_scores(ingest.event_stream(spark, folder), "user_id", "event_id", 3600, scored, path, state, by_events=False).collect()
    # All calls come at once, whatever their times say.
    assert sorted(r.event_id for r in run() if not r.throttled) == [0, 1]
    deliver(spark, folder, [(20, 0, 5), (21, 7, 5)])
    assert sorted(r.event_id for r in run() if not r.throttled) == [0, 1, 21]


def pages(spark, folder, ids):
    rows = [(i, f"http://{'shop.example.com' if i % 5 else 'other.org'}/a?utm_source=s{i % 3}", "") for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")


def test_beacons_follow_the_tags_of_their_batch(spark, tmp_path):
    folder, path, state, tags = (str(tmp_path / n) for n in ("in", "out", "state", "tags"))
    site_tags(spark).coalesce(1).write.parquet(tags)
    read = lambda: spark.read.parquet(tags)
    run = lambda: live.stream_beacons(beacon_rows(ingest.table_stream(spark, folder, "pages.parquet")), read, ("ctr", "reach"), path, state)
    batch = lambda ids: {(r.page_id, r.problem) for r in beacons.collected(beacon_rows(spark.read.parquet(f"{folder}/pages.parquet").where(F.col("page_id").isin(ids))), read(), ("ctr", "reach")).collect()}
    ids = list(range(200))
    pages(spark, folder, ids)
    good, bad = run()
    expected = batch(ids)
    assert {(r.page_id, None) for r in good.collect()} | {(r.page_id, r.problem) for r in bad.collect()} == expected
    assert good.count() + bad.count() == 200 and "problem" not in good.columns
    site_tags(spark).withColumn("active", F.lit(True)).coalesce(1).write.mode("overwrite").parquet(tags)
    later = list(range(200, 400))
    pages(spark, folder, later)
    expected |= batch(later)
    for _ in range(2):
        good, bad = run()
        assert {(r.page_id, None) for r in good.collect()} | {(r.page_id, r.problem) for r in bad.collect()} == expected
    assert good.where("page_id >= 200 and tag_id = 't3'").count() > 0 == good.where("page_id < 200 and tag_id = 't3'").count()


def test_a_crash_between_the_beacons_sinks_changes_nothing(spark, tmp_path, monkeypatch):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages(spark, folder, range(90))
    stream = lambda: beacon_rows(ingest.table_stream(spark, folder, "pages.parquet"))
    whole = live.append_batches

    def breaking(path):
        write = whole(path)

        def sink(batch, number):
            if path.endswith("rejected"):
                raise RuntimeError("down")
            write(batch, number)

        return sink

    monkeypatch.setattr(live, "append_batches", breaking)
    try:
        live.stream_beacons(stream(), lambda: site_tags(spark), ("ctr", "reach"), path, state)
        raise AssertionError("went on")
    except Exception as e:
        assert "down" in str(e) and len(list(Path(path, "accepted").glob("*"))) == 1
    monkeypatch.setattr(live, "append_batches", whole)
    good, bad = live.stream_beacons(stream(), lambda: site_tags(spark), ("ctr", "reach"), path, state)
    assert good.count() + bad.count() == 90 == good.select("page_id").unionByName(bad.select("page_id")).distinct().count()
