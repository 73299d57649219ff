"""Settings with bounds, rescoring, nudges and spending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S

#: Orders of saved analyses, by name: the column, and whether it ascends.
SORTS = {"newest": ("created_at", False), "oldest": ("created_at", True), "confidence_desc": ("confidence", False), "confidence_asc": ("confidence", True), "name_asc": ("source_name", True), "name_desc": ("source_name", False)}


def setting_problem(kind: str = "value_type", value: str = "value", bounds: str = "bounds") -> Column:
    """Why a setting (its JSON value and bounds as text) is not valid; null if it is."""
    v, b = F.col(value), F.coalesce(F.col(bounds), F.lit("{}"))
    number = F.when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), v.try_cast("double"))
    limit = lambda n: F.nullif(F.get_json_object(b, f"$.{n}"), F.lit("")).try_cast("double")
    options = F.from_json(F.get_json_object(b, "$.options"), "array<string>")
    text = F.regexp_replace(v, '^"|"$', "")
    numeric = F.when(number.isNull(), "expects a number").when(number < limit("min"), "below min").when(number > limit("max"), "above max")
    boolean = F.when(~F.coalesce(v.isin("true", "false"), F.lit(False)), "expects a boolean")
    choice = F.when(options.isNotNull() & ~F.coalesce(F.array_contains(options, text), F.lit(False)), "not an allowed option")
    return F.when(F.col(kind) == "number", numeric).when(F.col(kind) == "boolean", boolean).when(F.col(kind) == "enum", choice)


def audit(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``key, old_value, new_value`` of the settings that are new or changed; nulls are equal."""
    before = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("__had"))
    joined = new.select(key, F.col(value).alias("new_value")).join(before, key, "left")
    return joined.where(F.col("__had").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))).select(key, "old_value", "new_value")


def rescored(queue: DataFrame, cache: DataFrame, ids: DataFrame, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queue and cache after the rows of ``ids`` are pending again, with three attempts more than
    they used at least; with ``fresh`` their signatures leave the cache."""
    asked = ids.select("id").distinct().withColumn("__asked", F.lit(True))
    joined = queue.join(asked, "id", "left").withColumn("__asked", F.coalesce("__asked", F.lit(False)))
    status = F.when(F.col("__asked"), "pending").otherwise(F.col("status"))
    most = F.when(F.col("__asked"), F.greatest(F.coalesce("max_attempts", F.lit(3)), F.col("attempts") + 3)).otherwise(F.col("max_attempts"))
    after = joined.withColumns({"status": status, "max_attempts": most}).select(*queue.columns)
    if not fresh:
        return after, cache
    gone = joined.where("__asked").select(S.tag_signature("report_type", "codes").alias("signature"), "report_type").distinct()
    return after, cache.join(gone, ["signature", "report_type"], "left_anti")


def nudges(coverage: DataFrame, pending: int, unreviewed: int, hours_since: float | None, most_pending: int = 25, least_pct: float = 60.0, most_unreviewed: int = 25, stale_hours: float = 36.0) -> DataFrame:
    """``id, metric, threshold, severity, action``: what needs a look. ``coverage``: ``branch, pct``;
    its worst branch counts (the first of those that tie)."""
    schema = "id string, metric double, threshold double, severity string, action string"
    rows = []
    if pending > most_pending:
        rows.append(("backlog", float(pending), float(most_pending), "critical" if pending > 4 * most_pending else "warn", "run"))
    if hours_since is not None and hours_since > stale_hours:
        rows.append(("stale", float(int(hours_since + 0.5)), float(stale_hours), "critical" if hours_since > 3 * stale_hours else "warn", "run"))
    elif hours_since is None and pending > 0:
        rows.append(("never-run", float(pending), 0.0, "warn", "run"))
    if unreviewed > most_unreviewed:
        rows.append(("review", float(unreviewed), float(most_unreviewed), "warn", "review"))
    known = coverage.sparkSession.createDataFrame(rows, schema)
    worst = coverage.orderBy("pct", "branch").limit(1).where(F.col("pct") < least_pct)
    thin = worst.select(F.lit("coverage").alias("id"), F.round("pct", 1).alias("metric"), F.lit(float(least_pct)).alias("threshold"), F.when(F.col("pct") < least_pct / 2, "critical").otherwise("warn").alias("severity"), F.lit("run").alias("action"))
    return known.unionByName(thin)


def spent(nodes: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: ``usd`` of the proposals (JSON) of agents in the last ``hours``."""
    late = F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(hours)} hours")
    return nodes.where((F.col("source") == "agent") & late).agg(F.coalesce(F.sum(F.get_json_object("proposal", "$.usd").try_cast("double")), F.lit(0.0)).alias("usd"))


def saved(analyses: DataFrame, sort: str = "newest", days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Saved analyses of the last ``days`` in one of ``SORTS``' orders; ties by ``analysis_id``."""
    name, up = SORTS[sort]
    out = analyses
    if days is not None:
        out = out.where(F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(days)} days"))
    return out.orderBy(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last(), "analysis_id")
