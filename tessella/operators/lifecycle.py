"""Queues, retention, merges and paging, as set operations that return new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.delivery import activation_id


def claim(queue: DataFrame, as_of: str, most: int, stale_minutes: int = 5) -> DataFrame:
    """``job_id, attempts``: jobs to work on next: first those claimed too long ago, by that time,
    then pending ones that are due, oldest first; a claim counts as an attempt, and jobs without
    one left are passed over. A missing ``next_attempt_at`` is due."""
    now = F.to_timestamp(F.lit(as_of))
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(f"interval {int(stale_minutes)} minutes"))
    due = F.coalesce(F.col("next_attempt_at") <= now, F.lit(True)) if "next_attempt_at" in queue.columns else F.lit(True)
    ready = queue.where((stale | ((F.col("status") == "pending") & due)) & (F.col("attempts") < F.col("max_attempts")))
    first, at = F.when(stale, 0).otherwise(1), F.when(stale, F.col("claimed_at")).otherwise(F.col("created_at"))
    return ready.orderBy(first, at, "job_id").limit(min(max(most, 1), 64)).select("job_id", (F.col("attempts") + 1).alias("attempts"))


def retire(queue: DataFrame, most_attempts: int) -> DataFrame:
    """The queue with failed jobs dead after ``most_attempts``, else pending again."""
    failed = F.col("status") == "failed"
    return queue.withColumn("status", F.when(failed & (F.col("attempts") >= most_attempts), "dead_letter").when(failed, "pending").otherwise(F.col("status")))


def reap(files: DataFrame, as_of: str, stale_minutes: int = 30) -> DataFrame:
    """The files with claims whose last sign of life (``heartbeat_at``, else ``started_at``, else
    ``discovered_at``) is older than ``stale_minutes``, 5 at least, free again."""
    cut = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {max(5, int(stale_minutes))} minutes")
    stale = F.coalesce((F.col("status") == "processing") & (F.coalesce("heartbeat_at", "started_at", "discovered_at") < cut), F.lit(False))
    return files.withColumns({"status": F.when(stale, "discovered").otherwise(F.col("status")), "started_at": F.when(~stale, F.col("started_at"))})


#: Database errors that no retry mends.
PERMANENT_CODES = ("42703", "42P01", "42804", "22P02", "23502", "23503")


def classify_failures(df: DataFrame) -> DataFrame:
    """``df`` (``status_code, code, message``) with ``kind, retryable, shrink, backoff_ms``."""
    status, code = F.col("status_code"), F.coalesce("code", F.lit(""))
    said = F.upper(F.concat_ws(" ", F.coalesce("message", F.lit("")), code))
    hint = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("message", F.lit("")), r'"?retryAfterMs"?\s*[:=]\s*(\d+)', 1), F.lit("")).cast("int"), F.lit(0))
    is_ = lambda *codes: F.coalesce(status.isin(*codes), F.lit(False))
    schema = code.isin(*PERMANENT_CODES) | said.rlike("COLUMN .* DOES NOT EXIST|RELATION .* DOES NOT EXIST|SCHEMA CACHE|VIOLATES (NOT-NULL|FOREIGN KEY|CHECK)|INVALID INPUT SYNTAX")
    verdicts = [
        (is_(402) | said.rlike("INSUFFICIENTCREDITS|PAYMENT REQUIRED"), "credits", False, False, F.lit(0)),
        (is_(403), "policy", False, False, F.lit(0)),
        (is_(401), "auth", False, False, F.lit(0)),
        (schema | is_(400, 404, 422), "schema", False, False, F.lit(0)),
        (is_(546) | said.rlike("WORKER_RESOURCE_LIMIT|COMPUTE RESOURCES|CPU TIME|MEMORY LIMIT|OUT OF MEMORY|HEAP"), "resource", True, True, F.lit(5000)),
        (is_(504) | said.rlike("IDLE_TIMEOUT|TIMED? ?OUT|DEADLINE|ABORTERROR"), "resource", True, True, F.lit(4000)),
        (is_(429) | said.rlike("RATE ?LIMIT|TOO MANY REQUESTS"), "rate_limit", True, False, F.greatest(hint, F.lit(15_000))),
        (F.coalesce(status >= 500, F.lit(False)) | said.rlike("FETCH FAILED|NETWORK|ECONNRESET|SOCKET"), "transient", True, False, F.lit(2000)),
    ]
    made = lambda kind, retry, shrink, wait: F.struct(F.lit(kind).alias("kind"), F.lit(retry).alias("retryable"), F.lit(shrink).alias("shrink"), wait.alias("backoff_ms"))
    verdict = None
    for which, *rest in verdicts:
        verdict = F.when(which, made(*rest)) if verdict is None else verdict.when(which, made(*rest))
    verdict = verdict.otherwise(made("unknown", True, True, F.lit(3000)))
    return df.withColumn("__v", verdict).select(*df.columns, "__v.kind", "__v.retryable", "__v.shrink", "__v.backoff_ms")


def backoff(wait_ms: Column, attempt: Column, jitter_ms: Column | int = 0) -> Column:
    """Milliseconds to wait: doubled with each attempt after the first, from 500 at least."""
    jitter = F.lit(jitter_ms) if isinstance(jitter_ms, int) else jitter_ms
    return F.round(F.greatest(wait_ms, F.lit(500)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)) + jitter).cast("long")


def settle(queue: DataFrame) -> DataFrame:
    """Jobs (``job_id, outcome, attempts, max_attempts, step_scale`` and the verdict of
    ``classify_failures``) with their next ``status``, ``attempts``, ``step_scale`` and ``wait_ms``.

    Scored jobs are done and unchanged ones skipped. An account that stopped gets its attempt
    back; a failure that no retry mends, or that used the last attempt, is dead; others wait,
    with half the work, a quarter at least, where the verdict says so.
    """
    failed = F.col("outcome") == "failed"
    stop = F.col("kind").isin("credits", "policy")
    dead = failed & ~stop & (~F.col("retryable") | (F.col("attempts") >= F.col("max_attempts")))
    status = F.when(F.col("outcome") == "scored", "done").when(F.col("outcome") == "unchanged", "skipped").when(dead, "dead_letter").otherwise("pending")
    attempts = F.when(failed & stop, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts"))
    scale = F.when(failed & F.col("shrink"), F.greatest(F.lit(0.25), F.col("step_scale") * 0.5)).otherwise(F.col("step_scale"))
    wait = F.when(status == "pending", backoff(F.col("backoff_ms"), F.col("attempts")))
    return queue.select("job_id", status.alias("status"), attempts.alias("attempts"), scale.alias("step_scale"), wait.alias("wait_ms"))


def queue_positions(jobs: DataFrame, cap: int = 500) -> DataFrame:
    """``job_id, position`` of the first ``cap`` pending jobs, from 1: by priority, highest first,
    then by age. The limit bounds the one task that numbers them."""
    first = jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "job_id").limit(cap)
    return first.select("job_id", F.row_number().over(Window.orderBy(F.desc("priority"), "created_at", "job_id")).alias("position"))


def purge_cascade(owners: DataFrame, dependants: dict[str, DataFrame], key: str, as_of: str, days: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Owners seen (``last_seen``, else ``updated_at``, else ``created_at``) in the last ``days``, and
    of each dependant table the rows whose owner was not purged."""
    cut = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(days)} days")
    old = F.coalesce("last_seen", "updated_at", "created_at") < cut
    gone = owners.where(old).select(key).distinct()
    return owners.where(~F.coalesce(old, F.lit(False))), {n: df.join(gone, key, "left_anti") for n, df in dependants.items()}


def purge(df: DataFrame, seen: Column, as_of: str, days: int) -> DataFrame:
    """Rows seen in the last ``days`` before ``as_of``; rows never seen stay."""
    cut = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(days)} days")
    return df.where(seen.isNull() | (seen >= cut))


def rekey(rows: DataFrame, new_key: Column) -> DataFrame:
    """``key, observations, last_seen, codes`` with the keys mapped and rows that meet merged:
    observations add up, the latest time and all codes stay."""
    named = rows.withColumn("key", new_key)
    codes = named.select("key", F.explode("codes").alias("c")).groupBy("key").agg(F.array_sort(F.collect_set("c")).alias("codes"))
    sums = named.groupBy("key").agg(F.sum("observations").alias("observations"), F.max("last_seen").alias("last_seen"))
    return sums.join(codes, "key", "left").select("key", "observations", "last_seen", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def merge_additive(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The snapshot after an upsert that adds ``value`` where keys meet; null keys meet too."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after an upsert in which new rows replace old ones of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def page_after(df: DataFrame, key: str, after: object | None, most: int) -> DataFrame:
    """The ``most`` least distinct keys greater than ``after``."""
    keys = df.select(key).distinct()
    return (keys if after is None else keys.where(F.col(key) > F.lit(after))).orderBy(key).limit(most)


def batch_status(results: DataFrame) -> DataFrame:
    """``batch_id, rows, scored, failed, status`` of ``batch_id, outcome`` rows: completed without a
    failure, failed without a success, else partial."""
    per = results.groupBy("batch_id").agg(F.count("*").alias("rows"), F.count_if(F.col("outcome") == "scored").alias("scored"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return per.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("scored") == 0, "failed").otherwise("partial"))


def sweep_candidates(sources: DataFrame, as_of: str, after: object | None = None, most: int = 100, hours: int = 24) -> DataFrame:
    """The next ``most`` sources (1 to 500) by ``source_id`` after one, that have a vector and were
    not checked in the last ``hours``."""
    old = F.coalesce(F.col("checked_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(hours)} hours"), F.lit(True))
    rows = sources.where(F.col("has_vector") & old)
    rows = rows if after is None else rows.where(F.col("source_id") > F.lit(after))
    return rows.orderBy("source_id").limit(min(max(most, 1), 500))


#: Sweeps that are under way.
ACTIVE = ("running", "paused")


def rescore_pending(analyses: DataFrame, sources: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row, ``sources_with_vector, text_only_with_vector, pending``: analyses grounded by text only
    whose source has a vector, and those of them not checked in the last ``hours``."""
    known = sources.where("has_vector").select("source_id", "checked_at")
    rows = analyses.where(F.coalesce("grounding_level", F.lit("text-only")) == "text-only").join(known, "source_id")
    old = F.coalesce(F.col("checked_at") < F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {max(int(hours), 1)} hours"), F.lit(True))
    counts = rows.agg(F.count("*").alias("text_only_with_vector"), F.count_if(old).alias("pending"))
    return known.agg(F.count("*").alias("sources_with_vector")).crossJoin(F.broadcast(counts))


def _fresh_sweep(sweeps: DataFrame, at: str, batch: int, note: str | None) -> DataFrame:
    last = sweeps.agg(F.coalesce(F.max("sweep_id"), F.lit(0)).alias("m"))  # one row
    return last.select((F.col("m") + 1).cast("long").alias("sweep_id"), F.lit("running").alias("status"), F.lit(batch).alias("batch_size"), F.lit(note).cast("string").alias("note"), F.to_timestamp(F.lit(at)).alias("updated_at"))


def controlled_sweeps(sweeps: DataFrame, action: str, at: str, batch: int = 100) -> DataFrame:
    """The sweeps (``sweep_id, status, batch_size, note, updated_at``) after ``start`` (go on with what
    is under way, else begin one), ``restart`` (end that and begin one) or ``pause``."""
    size, now, active = min(max(batch, 1), 500), F.to_timestamp(F.lit(at)), F.col("status").isin(*ACTIVE)
    fresh = _fresh_sweep(sweeps, at, size, None)
    if action == "start":
        changed = sweeps.withColumns({"status": F.when(active, "running").otherwise(F.col("status")), "batch_size": F.when(active, size).otherwise(F.col("batch_size")), "note": F.when(~active, F.col("note")), "updated_at": F.when(active, now).otherwise(F.col("updated_at"))})
        none = sweeps.agg(F.coalesce(F.bool_or(active), F.lit(False)).alias("any")).where("NOT any")
        return changed.unionByName(fresh.crossJoin(F.broadcast(none)).drop("any"))
    if action == "restart":
        ended = sweeps.withColumns({"updated_at": F.when(active, now).otherwise(F.col("updated_at")), "status": F.when(active, "done").otherwise(F.col("status"))})
        return ended.unionByName(fresh)
    if action == "pause":
        runs = F.col("status") == "running"
        return sweeps.withColumns({"updated_at": F.when(runs, now).otherwise(F.col("updated_at")), "status": F.when(runs, "paused").otherwise(F.col("status"))})
    raise ValueError(f"unknown action: {action}")


def autostarted_sweeps(sweeps: DataFrame, pending: DataFrame, at: str) -> DataFrame:
    """The sweeps, and a new one of batches of 200 where none is under way and ``pending`` (its one
    row) says that there is work."""
    idle = sweeps.agg((~F.coalesce(F.bool_or(F.col("status").isin(*ACTIVE)), F.lit(False))).alias("idle")).crossJoin(F.broadcast(pending.select("pending"))).where("idle AND pending > 0")
    fresh = _fresh_sweep(sweeps, at, 200, "auto-started for newly grounded audiences")
    return sweeps.unionByName(fresh.crossJoin(F.broadcast(idle)).drop("idle", "pending"))


def sweep_status(sweeps: DataFrame, pending: DataFrame) -> DataFrame:
    """The sweep under way, else the one that changed last, with the counts of ``rescore_pending``;
    one row, with nulls for the sweep where there is none."""
    first = sweeps.orderBy(F.col("status").isin(*ACTIVE).desc(), F.desc("updated_at"), F.desc("sweep_id")).limit(1)
    return pending.join(F.broadcast(first), F.lit(True), "left")


def backfilled_activations(queue: DataFrame, most: int = 200_000, order: str = "id") -> DataFrame:
    """The queue with the activation that the object key tells in the first ``most`` (1 to 500 000)
    rows by ``order`` that have none and whose key tells one."""
    told = activation_id("object_key")
    todo = queue.where(F.col("activation_id").isNull() & told.isNotNull()).select(F.col(order).alias("__id"), told.alias("__told")).orderBy("__id").limit(min(max(most, 1), 500_000))
    return queue.join(todo, F.col(order) == F.col("__id"), "left").withColumn("activation_id", F.coalesce("activation_id", "__told")).select(*queue.columns)
