"""Reports on activations, cohorts, feeds and populations: one aggregate pass each.

Where a report looks at a sample, ``sample`` tells its rows in a stable order; without one it
looks at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions.storage import ranked_counts

AXES = list(S.AXES)


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(0.0)


def sampled(df: DataFrame, most: int | None, *order: Column) -> DataFrame:
    return df if most is None else df.orderBy(*order).limit(most)


def signal_coverage(signals: DataFrame, activation: str | None = None) -> DataFrame:
    """``activation_id, identifiers, tagged, scored`` of ``activation_id, tagged, scored`` rows,
    one for each identifier and family of signals; without an activation: unassigned."""
    named = signals.withColumn("activation_id", F.coalesce("activation_id", F.lit("unassigned")))
    named = named if activation is None else named.where(F.col("activation_id") == activation)
    return named.groupBy("activation_id").agg(F.count("*").alias("identifiers"), F.count_if("tagged").alias("tagged"), F.count_if("scored").alias("scored"))


def cohort_list(cohorts: DataFrame, members: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """``cohorts`` with their ``members``, those held out, the mean similarity and, given
    ``exports``, the time of the last one; cohorts without members have zeros."""
    per = members.groupBy("cohort_id").agg(F.count("*").alias("members"), F.count_if("holdout").alias("holdout"), F.round(F.avg("similarity"), 4).alias("avg_similarity"))
    out = cohorts.join(per, "cohort_id", "left").fillna(0, subset=["members", "holdout"])
    if exports is None:
        return out
    return out.join(exports.groupBy("cohort_id").agg(F.max("exported_at").alias("last_export_at")), "cohort_id", "left")


def segment_lift(events: DataFrame, segment: DataFrame, most: int = 25) -> DataFrame:
    """Per ``metric``: events, devices and mean of the ``device_id`` of ``segment`` against all
    others, and the lift of the mean in percent of the others'; the ``most`` metrics by devices."""
    inside = segment.select("device_id").distinct().withColumn("inside", F.lit(True))
    told = events.where("metric is not null and value is not null").join(inside, "device_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    # Counted per device first, so a distinct count needs no second pass over events.
    device = told.groupBy("metric", "device_id", "inside").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    arm = lambda c, within: F.when(F.col("inside") if within else ~F.col("inside"), c)
    per = device.groupBy("metric").agg(
        *[f.alias(f"{name}_{k}") for name, within in (("segment", True), ("other", False)) for k, f in (
            ("events", F.coalesce(F.sum(arm(F.col("n"), within)), F.lit(0))), ("devices", F.count(arm(F.col("device_id"), within))),
            ("avg", F.round(F.sum(arm(F.col("s"), within)) / F.sum(arm(F.col("n"), within)), 3)))]
    )
    lift = F.when(F.col("other_avg") != 0, F.round((F.col("segment_avg") - F.col("other_avg")) / F.abs("other_avg") * 100, 1))
    return per.withColumn("lift_pct", lift).orderBy(F.desc("segment_devices"), F.desc("segment_events"), "metric").limit(most)


def axis_means(scored: DataFrame, digits: int = 1) -> DataFrame:
    """``axis, score``: the mean of each axis over the rows that have it."""
    means = scored.agg(*[F.round(F.avg(a), digits).alias(a) for a in AXES])
    return means.unpivot([], AXES, "axis", "score").where("score is not null")


def enrichment_status(queue: DataFrame) -> DataFrame:
    """Per ``activation_id``: rows in all, scored, waiting and failed, scored share, confidence."""
    status = F.col("status")
    per = queue.groupBy("activation_id").agg(
        F.count("*").alias("rows_total"), F.count_if(status == "done").alias("rows_scored"), F.count_if(status.isin("pending", "processing")).alias("rows_waiting"),
        F.count_if(status.isin("failed", "dead_letter")).alias("rows_failed"), F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    return per.withColumn("coverage_pct", _share(F.col("rows_scored"), F.col("rows_total")))


def top_labels(rows: DataFrame, labels: str = "labels", most: int = 20) -> DataFrame:
    """``activation_id, label, rows, rank``: the most frequent labels of each activation."""
    per = rows.select("activation_id", F.explode(labels).alias("label")).where("label is not null").groupBy("activation_id", "label").agg(F.count("*").alias("rows"))
    rank = F.row_number().over(Window.partitionBy("activation_id").orderBy(F.desc("rows"), "label"))
    return per.withColumn("rank", rank).where(F.col("rank") <= most)


def label_parts(rows: DataFrame, labels: str, default: str) -> DataFrame:
    """A row for each label: ``family`` and ``value`` around the first ``": "``; a label without
    one is a value of the family in the column ``default``."""
    each = rows.withColumn("label", F.explode(F.transform(labels, lambda x: F.trim(x)))).where("label != ''")
    at = F.locate(": ", F.col("label"))
    family = F.when(at > 0, F.expr("substr(label, 1, locate(': ', label) - 1)")).otherwise(F.coalesce(default, F.lit("unknown")))
    return each.withColumns({"family": family, "value": F.when(at > 0, F.expr("substr(label, locate(': ', label) + 2)")).otherwise(F.col("label"))})


def signal_families(parts: DataFrame, most: int = 20) -> DataFrame:
    """``family, n_values, devices`` by devices."""
    per = parts.groupBy("family", "value", "id").agg(F.lit(1).alias("one")).groupBy("family").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("id").alias("devices"))
    return per.orderBy(F.desc("devices"), "family").limit(most)


def signal_axes(parts: DataFrame, least: int = 3, most: int = 12, family: str | None = None) -> DataFrame:
    """``family, value, devices, audio_devices, avg_confidence``, the mean axes, ``lead`` and
    ``lead_score``, of the values with ``least`` devices or more that have scores. The first axis
    of those that tie leads."""
    some = parts.where(" or ".join(f"{a} is not null" for a in AXES))
    some = some if family is None else some.where(F.col("family") == family)
    per = some.groupBy("family", "value").agg(
        F.countDistinct("id").alias("devices"), F.countDistinct(F.when(F.col("audio"), F.col("id"))).alias("audio_devices"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"), *[F.avg(a).alias(f"__{a}") for a in AXES],
    ).where(F.col("devices") >= least)
    best = F.greatest(*[F.col(f"__{a}") for a in AXES])
    lead = F.coalesce(*[F.when(F.col(f"__{a}") == best, a) for a in AXES])
    out = per.select("family", "value", "devices", "audio_devices", "avg_confidence", *[F.round(f"__{a}", 1).alias(a) for a in AXES], lead.alias("lead"), F.round(best, 1).alias("lead_score"))
    return out.orderBy(F.desc("devices"), "family", "value").limit(most)


def signal_devices(parts: DataFrame, family: str, value: str, offset: int = 0, most: int = 25) -> DataFrame:
    """``id, labels, first_seen, last_seen`` of the devices of a value, a page by last seen."""
    ids = parts.where((F.col("family") == family) & (F.col("value") == value)).select("id").distinct()
    per = parts.join(ids, "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return per.orderBy(F.desc("last_seen"), "id").offset(offset).limit(most)


def own_data(records: DataFrame) -> DataFrame:
    """``dataset_id, rows, scored, avg_confidence, with_kpi, last_at`` and one row, of a null
    dataset, for all."""
    aggs = [F.count("*").alias("rows"), F.count_if(F.col("status") == "scored").alias("scored"), F.round(F.avg(F.when(F.col("status") == "scored", F.col("confidence"))), 3).alias("avg_confidence"), F.count("kpi").alias("with_kpi"), F.max("updated_at").alias("last_at")]
    total = records.agg(*aggs).select(F.lit(None).cast("string").alias("dataset_id"), "*")
    return records.groupBy(F.col("dataset_id").cast("string").alias("dataset_id")).agg(*aggs).unionByName(total)


def feed_status(records: DataFrame, analyses: DataFrame, as_of: str, sample: int | None = None) -> DataFrame:
    """Per ``dataset_id``: raw, scored, pending and failed rows, the age of the oldest pending
    row in hours, and of the scored rows, or ``sample`` of them, how many have an analysis and
    a grounded or bridged one, as shares and as estimates for all scored rows."""
    waiting = F.col("status").isNull() | F.col("status").isin("pending", "queued", "processing")
    per = records.groupBy("dataset_id").agg(
        F.count("*").alias("raw"), F.count_if(F.col("status") == "scored").alias("scored"), F.count_if(waiting).alias("pending"), F.count_if(F.col("status").isin("failed", "error")).alias("failed"),
        F.min(F.when(waiting, F.col("created_at"))).alias("oldest"), F.max(F.when(F.col("status") == "scored", F.col("updated_at"))).alias("last_scored_at"),
    )
    latest = analyses.groupBy("source_name").agg(F.max_by("grounding_level", F.struct("created_at", "analysis_id")).alias("level"), F.lit(True).alias("analysed"))
    scored = records.where("status = 'scored'").select("dataset_id", "record_id", "source_name")
    if sample is not None:
        rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy("record_id"))
        scored = scored.withColumn("__r", rank).where(F.col("__r") <= sample).drop("__r")
    seen = scored.join(latest, "source_name", "left").groupBy("dataset_id").agg(F.count("*").alias("sampled"), F.count("analysed").alias("enriched"), F.count_if(F.coalesce("level", F.lit("text-only")).isin("grounded", "bridged")).alias("tagged"))
    out = per.join(seen, "dataset_id", "left").fillna(0, subset=["sampled", "enriched", "tagged"])
    age = S.hours_between(F.to_timestamp(F.lit(as_of)), "oldest")
    known = F.col("sampled") > 0
    estimate = lambda c: F.when(known, F.round(F.col("scored") * (F.col(c) / F.col("sampled")))).otherwise(0.0)
    return out.select(
        "dataset_id", "raw", "scored", "pending", "failed", "last_scored_at", age.alias("pending_age_hours"), "sampled", _share(F.col("enriched"), F.col("sampled")).alias("enriched_pct"),
        _share(F.col("tagged"), F.col("sampled")).alias("tagged_pct"), estimate("enriched").alias("enriched_est"), estimate("tagged").alias("tagged_est"),
    )


def resolved(queue: DataFrame, profiles: DataFrame, cache: DataFrame) -> DataFrame:
    """``queue`` (``id, identifier, report_type, codes...``) with the six axes, ``confidence``,
    ``grounding`` and ``audio``: of the identifier's profile where there is one, else of the
    cached score of the row's signature, else none."""
    signed = queue.withColumn("signature", S.tag_signature("report_type", "codes"))
    own = profiles.select("identifier", F.lit(True).alias("__own"), F.col("confidence").alias("__oc"), *[F.col(a).alias(f"__o_{a}") for a in AXES])
    kept = cache.select("signature", "report_type", F.lit(True).alias("__kept"), F.col("confidence").alias("__kc"), *[F.col(a).alias(f"__k_{a}") for a in AXES])
    joined = signed.join(own, "identifier", "left").join(kept, ["signature", "report_type"], "left")
    level = F.when(F.col("__own"), "audio-grounded").when(F.col("__kept"), "text-only").otherwise("unscored")
    base = [c for c in queue.columns if c != "confidence"]
    confidence = F.coalesce(*([F.col("confidence")] if "confidence" in queue.columns else []), "__kc", "__oc")
    return joined.select(*base, "signature", confidence.alias("confidence"), level.alias("grounding"), F.coalesce("__own", F.lit(False)).alias("audio"), *[F.when(F.col("__own"), F.col(f"__o_{a}")).otherwise(F.col(f"__k_{a}")).alias(a) for a in AXES])


def grounding_levels(profiles: DataFrame) -> DataFrame:
    """``level, profiles, identifiers, with_audio``."""
    return profiles.groupBy(F.coalesce("grounding_level", F.lit("text-only")).alias("level")).agg(F.count("*").alias("profiles"), F.sum("identifier_count").alias("identifiers"), F.count_if("has_audio").alias("with_audio"))


def population(profiles: DataFrame) -> DataFrame:
    """``axis, n, mean, sd, bins``: mean, population deviation and ten bins of ten points, the
    last one closed, of each axis, in one pass."""
    bins = lambda a: F.array(*[F.count_if((F.col(a) >= 10 * i) & ((F.col(a) < 10 * i + 10) if i < 9 else F.lit(True))) for i in range(10)])
    one = profiles.agg(*[F.struct(F.count(a).alias("n"), F.round(F.avg(a), 4).alias("mean"), F.round(F.stddev_pop(a), 4).alias("sd"), bins(a).alias("bins")).alias(a) for a in AXES])
    return one.unpivot([], AXES, "axis", "s").select("axis", "s.n", "s.mean", "s.sd", F.array_join(F.transform("s.bins", lambda x: x.cast("string")), ",").alias("bins"))


def activation_profile(queue: DataFrame, nodes: DataFrame, scored: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Tags and axes of each activation. Tags: ``activation_id, code, weight, rank``, the share of
    its rows that hold the code, of nodes that are not suppressed. Axes: means rounded to whole
    points, mean confidence and the leading axis."""
    rows = queue.groupBy("activation_id").agg(F.count("*").alias("rows"))
    hits = queue.select("activation_id", F.explode("codes").alias("code")).where("code != ''").groupBy("activation_id", F.lower("code").alias("code")).agg(F.count("*").alias("hits"))
    known = nodes.where(~F.coalesce("suppressed", F.lit(False))).select(F.lower("code").alias("code")).distinct()
    rank = F.row_number().over(Window.partitionBy("activation_id").orderBy(F.desc("hits"), "code"))
    tags = hits.join(known, "code", "left_semi").join(rows, "activation_id").withColumn("rank", rank).where(F.col("rank") <= most)
    tags = tags.select("activation_id", "code", F.round(F.col("hits") / F.greatest(F.lit(1), "rows"), 4).alias("weight"), "rank")
    per = queue.select("activation_id", "identifier").join(scored.select("identifier", "confidence", *AXES), "identifier").groupBy("activation_id").agg(F.count("*").alias("scored"), F.avg("confidence").alias("c"), *[F.avg(a).alias(a) for a in AXES])
    lead = S.leading_axis(AXES)
    axes = per.select("activation_id", "scored", F.round(S.clamp(F.coalesce("c", F.lit(0.5)), 0.0, 1.0), 3).alias("confidence"), lead.alias("lead"), *[F.round(F.coalesce(a, F.lit(0.0))).cast("int").alias(a) for a in AXES])
    return tags, axes


def dataset_state(queue: DataFrame) -> DataFrame:
    """``activation_id, row_count, scored_count, status``: ready once all rows are scored."""
    per = queue.groupBy("activation_id").agg(F.count("*").alias("row_count"), F.count_if(F.col("status") == "done").alias("scored_count"))
    return per.withColumn("status", F.when((F.col("scored_count") >= F.col("row_count")) & (F.col("row_count") > 0), "ready").otherwise("scoring"))


def cost_estimate(queue: DataFrame, cache: DataFrame, most: int = 10, sample: int | None = None) -> DataFrame:
    """Of the ``most`` activations by rows: done and pending rows, and of the pending ones, or
    ``sample`` of them, the rows whose signature is cached, distinct signatures, and those that
    are not cached and would cost."""
    acts = queue.where("activation_id is not null").groupBy("activation_id").agg(F.count("*").alias("total_rows"), F.count_if(F.col("status") == "done").alias("done_rows"), F.count_if(F.col("status") == "pending").alias("pending_rows"))
    acts = acts.orderBy(F.desc("total_rows"), "activation_id").limit(most)
    pending = queue.where("status = 'pending'").select("activation_id", "id", S.tag_signature("report_type", "codes").alias("signature"))
    if sample is not None:
        rank = F.row_number().over(Window.partitionBy("activation_id").orderBy("id"))
        pending = pending.withColumn("__r", rank).where(F.col("__r") <= sample)
    # Signatures are few: count rows of each, then look them up.
    per = pending.groupBy("activation_id", "signature").agg(F.count("*").alias("n")).join(cache.select("signature").distinct().withColumn("cached", F.lit(True)), "signature", "left")
    per = per.groupBy("activation_id").agg(F.sum("n").alias("sampled_rows"), F.sum(F.when(F.col("cached"), F.col("n")).otherwise(0)).alias("sampled_cached_rows"), F.count("*").alias("distinct_signatures"), F.count_if(F.col("cached").isNull()).alias("billable_signatures"))
    new = ["sampled_rows", "sampled_cached_rows", "distinct_signatures", "billable_signatures"]
    return acts.join(per, "activation_id", "left").fillna(0, subset=new)


def listener_profiles(identifiers: DataFrame, analyses: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each source that has identifiers and an analysis: counts and last time of its
    identifiers, the tags of the latest one, and the axes of its latest analysis."""
    own = identifiers.where("source_id is not null").groupBy("source_id").agg(
        F.count("*").alias("identifier_count"), F.greatest(F.sum(F.coalesce("observations", F.lit(1))), F.lit(1)).alias("observation_count"), F.max("last_seen").alias("last_seen"),
        F.max_by("tag_codes", F.struct("updated_at", "identifier")).alias("tag_codes"),
    )
    latest = analyses.where("source_id is not null").groupBy("source_id").agg(F.max_by(F.struct(*AXES, "confidence", "grounding_level"), F.struct("created_at", "analysis_id")).alias("a"))
    joined = own.join(latest, "source_id").join(sources.select("source_id", "has_audio"), "source_id", "left")
    return joined.select("source_id", "identifier_count", "observation_count", "last_seen", "tag_codes", *[F.coalesce(f"a.{x}", F.lit(0.0)).alias(x) for x in AXES], "a.confidence", "a.grounding_level", F.coalesce("has_audio", F.lit(False)).alias("has_audio"))


def queue_depth(queue: DataFrame, cap: int) -> DataFrame:
    """``waiting, dead``: rows to do and dead ones, each counted up to ``cap``."""
    upto = lambda which, name: queue.where(which).select(F.lit(1).alias("x")).limit(cap).agg(F.count("*").alias(name))
    # One row each.
    return upto(F.col("status").isin("pending", "processing"), "waiting").crossJoin(upto(F.col("status") == "dead_letter", "dead"))


def last_or_default(runs: DataFrame, default: dict, *order: Column) -> DataFrame:
    """The first run in ``order``; the ``default`` row where there is none."""
    fields = [F.lit(default.get(f.name)).cast(f.dataType).alias(f.name) for f in runs.schema.fields]
    stand_in = runs.sparkSession.range(1).select(*fields, F.lit(1).alias("__last"))
    rank = [*order]
    best = runs.orderBy(*rank).limit(1).withColumn("__last", F.lit(0))
    return best.unionByName(stand_in).orderBy("__last").limit(1).drop("__last")


def custody_scan(**keys: DataFrame) -> DataFrame:
    """``violations_total, clean`` and, per named table of ``key`` rows, how many keys have the
    shape of a device id (``device_<name>``) or an IP address (``ip_<name>``)."""
    out = None
    for name, df in keys.items():
        one = df.agg(F.count_if(S.is_device_id("key")).alias(f"device_{name}"), F.count_if(S.is_ipv4("key") | S.is_ipv6("key")).alias(f"ip_{name}"))
        out = one if out is None else out.crossJoin(one)
    total = sum((F.col(c) for c in out.columns), F.lit(0))
    return out.withColumn("violations_total", total).withColumn("clean", F.col("violations_total") == 0)


def floor_percentiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per key the values at place ``floor(share * (n - 1))`` of the ascending ones, as ``p50,
    p95...``, with ``top`` and ``samples``."""
    placed = ranked_counts(df, key, value)
    at = lambda q: F.floor(F.lit(q) * (F.col("__all") - 1))
    picked = [F.min(F.when(F.col("__run") > at(q), F.col(value))).alias(f"p{round(100 * q)}") for q in shares]
    return placed.groupBy(key).agg(*picked, F.max(value).alias("top"), F.max("__all").alias("samples"))
