"""Events of site tags: beacons and imported files, checked row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters of campaigns that a page's address may carry.
CAMPAIGN = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def url_parameter(url: Column, name: str, most: int = 400) -> Column:
    """A parameter of a URL's query, decoded and trimmed; null for none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{name}=([^&#]*)", 1)
    return F.nullif(F.substring(F.trim(F.try_url_decode(raw)), 1, most), F.lit(""))


def collected(beacons: DataFrame, tags: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """``beacons`` (``tag_id, origin, metric, value, page_url``, text) with the campaign parameters
    of the page, ``number`` and ``problem``, null where the event is taken.

    ``tags`` has ``tag_id, active, allowed_origins``: hosts, of which subdomains count too; an
    empty list or no origin lets all pass.
    """
    known = tags.select("tag_id", F.coalesce("active", F.lit(False)).alias("__active"), F.coalesce("allowed_origins", F.array().cast("array<string>")).alias("__from"))
    joined = beacons.join(known, "tag_id", "left") if "tag_id" in tags.columns else beacons
    host = F.regexp_extract(F.coalesce("origin", F.lit("")), r"^[a-z]+://([^/?#]+)", 1)
    clean = F.transform("__from", lambda a: F.regexp_replace(F.regexp_replace(a, "^https?://", ""), "/$", ""))
    may = (F.size("__from") == 0) | (F.coalesce("origin", F.lit("")) == "") | F.exists(clean, lambda a: (host == a) | host.endswith(F.concat(F.lit("."), a)))
    number = F.nullif(F.col("value"), F.lit("")).try_cast("double")
    bad = F.nullif(F.col("value"), F.lit("")).isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))
    metric = F.nullif(F.substring(F.trim("metric"), 1, 40), F.lit(""))
    problem = (
        F.when(F.coalesce(F.trim("tag_id"), F.lit("")) == "", "no tag").when(~F.coalesce("__active", F.lit(False)), "unknown or inactive tag").when(~may, "origin not allowed")
        .when(metric.isNotNull() & ~metric.isin(*metrics), "unknown metric").when(bad, "value is no number")
    )
    return joined.withColumns({**{c: url_parameter(F.col("page_url"), c) for c in (*CAMPAIGN, "gclid")}, "number": number, "problem": problem}).drop("__active", "__from")


def imported(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows (``device_id, metric, value, occurred_at``) of an upload of ``row, device_id,
    metric, value, occurred_at`` text, and ``row, reason`` of those left out."""
    value = F.nullif(F.trim("value"), F.lit("")).try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    when = F.try_to_timestamp("occurred_at")
    reason = F.when(~F.coalesce(good, F.lit(False)), "value is not a number").when((F.coalesce("occurred_at", F.lit("")) != "") & when.isNull(), "occurred_at is not a date")
    checked = rows.withColumns({"__v": value, "__t": when, "reason": reason})
    return checked.where("reason is null").select("device_id", "metric", F.col("__v").alias("value"), F.col("__t").alias("occurred_at")), checked.where("reason is not null").select("row", "reason")


def metric_summary(events: DataFrame) -> DataFrame:
    """``metric, events, devices, avg_value``."""
    per = events.groupBy("metric", "device_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return per.groupBy("metric").agg(F.sum("n").alias("events"), F.count("device_id").alias("devices"), F.round(F.sum("s") / F.sum("n"), 3).alias("avg_value"))


def score_coverage(events: DataFrame, records: DataFrame) -> DataFrame:
    """One row: distinct ``devices`` of events, those with a record, and records of these that are scored."""
    devices = events.select("device_id").distinct()
    own = records.groupBy("device_id").agg(F.count_if(F.col("status") == "scored").alias("scored"))
    return devices.join(own, "device_id", "left").agg(F.count("*").alias("devices"), F.count("scored").alias("matched"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
