"""Live streams: scores of users' windows with a throttle, and beacons of site tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessella.functions.storage import shared_path
from tessella.sources import beacons
from tessella.streaming.ingest import append_batches, run_available

#: A user's next score comes after this share of a window, or later.
GAP_SHARE = 0.8
#: The state store that state variables need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Throttle(StatefulProcessor):
    """One score a user and gap. The state of a user is the time of the last score, in
    microseconds, and the calls turned down since.

    By the events' clock a timer removes it once the watermark has passed the gap, as no call
    can be too early any more. By the clock of the machine it has a time to live of one gap.
    """

    def __init__(self, user: str, order: str, kept: list[str], gap: int, by_events: bool):
        self.user, self.order, self.kept, self.gap, self.by_events = user, order, kept, gap, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, turned_down long", None if self.by_events else max(1, self.gap // 1000))

    def _expiry(self, at: int) -> int:
        return -(-(at + self.gap) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", self.order])
        if not self.by_events:
            calls["at"] = timerValues.getCurrentProcessingTimeInMs() * 1000
        known = self.last.get() if self.last.exists() else None
        before, turned = known if known is not None else (None, 0)
        since, waits, missed = before, [], []
        for at in calls["at"].tolist():
            early = since is not None and at - since < self.gap
            waits.append((self.gap - (at - since)) // 1000 if early else None)
            missed.append(None if early else turned)
            turned = turned + 1 if early else 0
            since = since if early else at
        if self.by_events and since != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(since))
        self.last.update((since, turned))
        out = calls[[*self.kept, "at"]].copy()
        out.insert(0, self.user, key[0])
        out["throttled"] = [w is not None for w in waits]
        out["retry_in_ms"], out["turned_down"] = pd.array(waits, "Int64"), pd.array(missed, "Int64")
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def throttled_calls(stream: DataFrame, user: str, order: str, window_seconds: float, late: str = "10 minutes", by_events: bool = True) -> DataFrame:
    """The stream's columns without ``ts``, and ``at`` (microseconds), ``throttled``, ``retry_in_ms`` of a
    call turned down, and ``turned_down``, the calls turned down before one that is scored.

    A call is turned down if it comes less than ``GAP_SHARE`` of a window after its user's last
    score. Calls of one batch go by time, then by ``order``; a call older than the last score
    is turned down too. Calls later than ``late`` behind the watermark are left out. A task
    holds the calls of one user in one batch, which the source's limits of a trigger bound.
    """
    gap = int(window_seconds * GAP_SHARE * 1_000_000)
    known = stream.where(F.col(user).isNotNull()).withColumn("at", F.unix_micros("ts"))
    kept = [c for c in stream.columns if c not in (user, "ts")]
    kind = StructType([stream.schema[user], *[stream.schema[c] for c in kept]]).add("at", "long").add("throttled", "boolean").add("retry_in_ms", "long").add("turned_down", "long")
    dealt = (known.withWatermark("ts", late) if by_events else known).groupBy(user)
    return dealt.transformWithStateInPandas(Throttle(user, order, kept, gap, by_events), kind, "Append", "EventTime" if by_events else "ProcessingTime")


def live_scores(stream: DataFrame, user: str, order: str, window_seconds: float, score: Callable[[DataFrame], DataFrame], path: str | None = None, state: str | None = None, late: str = "10 minutes", by_events: bool = True) -> DataFrame:
    """Every call with what ``throttled_calls`` decides and, where it is not turned down, what
    ``score`` adds to it. With ``path`` and ``state`` kept, a later call goes on where the last one
    ended: at most one score per user and window, over all deliveries."""
    spark = stream.sparkSession
    path, state = path or shared_path(spark, "live"), state or shared_path(spark, "live-state")
    with _state_store(spark):
        calls = throttled_calls(stream, user, order, window_seconds, late, by_events)
        write = append_batches(path)

        def sink(batch: DataFrame, number: int) -> None:
            scored = score(batch)
            new = [c for c in scored.columns if c not in batch.columns]
            write(scored.select(*batch.columns, *[F.when(~F.col("throttled"), F.col(c)).alias(c) for c in new]), number)

        run_available(calls, sink, state, one_batch=not by_events)
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def stream_beacons(stream: DataFrame, tags: Callable[[], DataFrame], metrics: tuple[str, ...], path: str | None = None, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted beacons and rejected ones, with their ``problem``: each batch is checked against the
    tags as they are then, by ``beacons.collected``, and goes to two folders.

    ``tags`` reads the table anew for each batch, so a changed tag counts from the next one. A
    batch is decided once and its decisions are read by both sinks; both are named by the
    batch's number, so a replay after a crash between them replaces what was there.
    """
    spark = stream.sparkSession
    path, state = path or shared_path(spark, "beacons"), state or shared_path(spark, "beacons-state")
    sinks = [append_batches(f"{path}/{kind}") for kind in ("accepted", "rejected")]

    def sink(batch: DataFrame, number: int) -> None:
        checked = beacons.collected(batch, tags(), metrics)
        at = f"{path}/checked/batch={number}"
        checked.write.mode("overwrite").parquet(at)
        checked = spark.read.schema(checked.schema).parquet(at)
        sinks[0](checked.where("problem is null").drop("problem"), number)
        sinks[1](checked.where("problem is not null"), number)

    run_available(stream, sink, state)
    kind = beacons.collected(spark.createDataFrame([], stream.schema), tags(), metrics).schema
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
    return read("accepted", StructType([f for f in kind if f.name != "problem"])), read("rejected", kind)
