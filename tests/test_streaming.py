"""Streams over two deliveries with a kept checkpoint."""

from __future__ import annotations

from datetime import datetime

from tessella.streaming import ingest

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def deliver(spark, folder, rows):
    spark.createDataFrame([(i, ts, 1, "click", v, None) for i, ts, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_windows_over_two_deliveries(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    folder, path, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    deliver(spark, folder, [(i, at(1, i), 1.0) for i in range(10)])
    assert [(r.n, r.score) for r in ingest.stream_windows(spark, folder, path=path, state=state).collect()] == [(10, 1.0)]
    # The same window goes on, another begins; a third call finds nothing new.
    deliver(spark, folder, [(20 + i, at(1, 30 + i), 4.0) for i in range(5)] + [(40, at(3, 0), 2.0)])
    for _ in range(2):
        found = ingest.stream_windows(spark, folder, path=path, state=state).orderBy("start").collect()
        assert [(r.start.hour, r.n, r.score) for r in found] == [(1, 15, 2.0), (3, 1, 2.0)]
    # Far behind the watermark now: left out, and no window comes twice.
    deliver(spark, folder, [(50, at(1, 5), 9.0), (51, at(3, 1), 4.0)])
    found = ingest.stream_windows(spark, folder, path=path, state=state).orderBy("start").collect()
    assert [(r.start.hour, r.n, r.score) for r in found] == [(1, 15, 2.0), (3, 2, 3.0)]
