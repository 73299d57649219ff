"""Exports of cohorts, and upserts into queues and rollups, as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S

#: Fixed value: members that an exported cohort has at least.
LEAST_MEMBERS = 1000


def activation_rows(members: DataFrame) -> DataFrame:
    """``eid, subject_key`` of an activation file, in order: members that are not held out, with
    keys that have an export id; of keys with one id the first stays."""
    named = members.where(~F.coalesce("holdout", F.lit(False))).select(S.export_id("subject_key").alias("eid"), "subject_key").where("eid is not null")
    return named.groupBy("eid").agg(F.min("subject_key").alias("subject_key")).orderBy("eid")


def activation_counts(members: DataFrame) -> DataFrame:
    """One row: ``held_out``, ``skipped`` (keys without an export id) and distinct ``eids``."""
    held, eid = F.coalesce(F.col("holdout"), F.lit(False)), S.export_id("subject_key")
    rows = members.select(held.alias("held"), eid.alias("eid"))
    return rows.agg(F.count_if("held").alias("held_out"), F.count_if(~F.col("held") & F.col("eid").isNull()).alias("skipped"), F.countDistinct(F.when(~F.col("held"), F.col("eid"))).alias("eids"))


def object_key(slug: str, date: str) -> str:
    return f"outbound/activation/dt={date}/cohort={slug}/part-000.csv.gz"


def write_activation(members: DataFrame, root: str, slug: str, date: str) -> str:
    """Write the ids, one a line without a header, sorted and compressed; the folder."""
    path = f"{root.rstrip('/')}/{object_key(slug, date).rsplit('/', 1)[0]}"
    activation_rows(members).select("eid").write.mode("overwrite").option("compression", "gzip").csv(path)
    return path


def refusal(cohorts: DataFrame, least: int = LEAST_MEMBERS) -> Column:
    """Why a cohort (``slug, members, export_eligible``) may not be exported; null if it may."""
    floor = max(LEAST_MEMBERS, least)
    fits = F.coalesce(F.col("export_eligible"), F.lit(False)) & (F.col("members") >= floor)
    said = F.concat(F.lit('cohort "'), F.col("slug"), F.lit('" is not export eligible: '), F.col("members").cast("string"), F.lit(f" members, minimum is {floor}"))
    return F.when(~fits, said)


def exported_activations(members: DataFrame, queue: DataFrame) -> DataFrame:
    """``cohort_id, activation_id`` of the exported members' rows."""
    shown = members.where(~F.coalesce("holdout", F.lit(False))).select("cohort_id", F.col("subject_key").alias("identifier")).distinct()
    return queue.where("activation_id is not null").select("identifier", "activation_id").distinct().join(shown, "identifier").select("cohort_id", "activation_id").distinct()


def enqueue(queue: DataFrame, rows: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ("label",)) -> DataFrame:
    """The queue after an upsert that only changes rows still pending: new rows come in as pending;
    columns of ``keep_if_null`` keep their value where the new one is null. Rows without a key
    are left out; of rows that repeat one the last by all columns stays."""
    new = rows
    for k in keys:
        new = new.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    values = [c for c in rows.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__new"))
    joined = queue.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    fresh, open_ = F.col("__old").isNull(), (F.col("status") == "pending") & F.col("__new").isNotNull()
    out = []
    for c in queue.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in values:
            value = F.coalesce(F.col("__new")[c], F.col(c)) if c in keep_if_null else F.col("__new")[c]
            out.append(F.when(fresh | open_, value).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(fresh, F.lit("pending") if c == "status" else F.lit(None)).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def finish(queue: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """The queue with the columns of ``results`` put in where they are not null."""
    values = [c for c in results.columns if c != key]
    new = results.groupBy(key).agg(F.max(F.struct(*values)).alias("__new"))
    return queue.join(new, key, "left").select(*[F.coalesce(F.col("__new")[c], F.col(c)).alias(c) if c in values else F.col(c) for c in queue.columns])


def stage_rollups(rollups: DataFrame, ledger: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rollups and ledger after chunks of ``object_key, source_offset, part_key, subject, code,
    day, weight`` (text): chunks that the ledger knows add nothing, others add up by key.

    Subjects and codes are trimmed and cut to 512 and 200; rows without one are left out; a day
    that is not an ISO date is null, and null days meet; a missing weight is 1.
    """
    chunk = ["object_key", "source_offset", "part_key"]
    fresh = chunks.join(ledger, chunk, "left_anti")
    subject, code = F.substring(F.trim("subject"), 1, 512), F.substring(F.trim("code"), 1, 200)
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring("day", 1, 10)))
    rows = fresh.select("object_key", subject.alias("subject"), code.alias("code"), day.alias("day"), F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight")).where("subject != '' and code != ''")
    keys = ["object_key", "subject", "code", "day"]
    merged = rollups.select(*keys, "weight").unionByName(rows).groupBy(*keys).agg(F.sum("weight").alias("weight"))
    return merged, ledger.select(*chunk).unionByName(fresh.select(*chunk).distinct())


def daily_runs(events: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """``key, day, runs, allowed``: runs of each key and UTC day, and whether another may start."""
    return events.groupBy(key, F.to_date(at).alias("day")).agg(F.count("*").alias("runs")).withColumn("allowed", F.col("runs") < limit)


def changed(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key`` of the rows of ``new`` that differ in a value, nulls being equal, or are new."""
    a = old.select(key, F.struct(*values).alias("__a"), F.lit(True).alias("__has"))
    joined = new.select(key, F.struct(*values).alias("__b")).join(a, key, "left")
    return joined.where(F.col("__has").isNull() | ~F.col("__a").eqNullSafe(F.col("__b"))).select(key)
