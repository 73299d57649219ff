"""Registered queries on deliveries, dashboards, exports and score algebra, each with its SQL.

The driver's tables stand in: orders for a queue of scoring tasks and for enterprise records,
daily events of a user for analyses, pages and customers for delivery rows, parts for a
taxonomy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import algebra, audience, dashboards, export, learning, lifecycle, vectors
from tessella.operators.profiles import AXIS_EVENTS
from tessella.sources import delivery, normalise, quality

AXES = list(S.AXES)
TARGET = dict(zip(AXES, (60.0, 55.0, 50.0, 45.0, 50.0, 50.0)))
WEIGHTS = dict(zip(AXES, (2.0, 1.0, 0.5, 1.0, 1.0, 3.0)))
AS_OF = "2024-01-31 00:00:00"


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _profile_of(events: DataFrame, *keys) -> DataFrame:
    cap = lambda c: F.coalesce(F.least(F.lit(100.0), c), F.lit(50.0))
    axes = [cap(S.exact_mean(F.when(F.col("event_type") == e, F.col("value")))).alias(a) for a, e in zip(AXES, AXIS_EVENTS)]
    return events.groupBy(*keys).agg(*axes, cap(S.exact_mean("value")).alias(AXES[-1]), F.count("*").alias("n"))


def profiles(s: SparkSession, d: str) -> DataFrame:
    return _profile_of(load(s, d, "events"), "user_id")


def analyses(s: SparkSession, d: str) -> DataFrame:
    per = _profile_of(load(s, d, "events"), "user_id", F.to_date("ts").alias("day"))
    return per.withColumns({"confidence": F.least(F.lit(1.0), F.col("n") / 10), "created_at": F.col("day").cast("timestamp"), "analysis_id": F.col("user_id") * 100 + F.dayofmonth("day")})


KINDS = ("ctv", "apps", "visitation", "demographics", "origin")
STATES = ("done", "done", "pending", "processing", "failed", "dead_letter")


def _nth(column: str, names: tuple[str, ...]) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(column) % len(names) + 1).cast("int"))


def tasks(s: SparkSession, d: str) -> DataFrame:
    priority = F.lower(F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("")))
    return load(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("identifier"), F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")).alias("activation_id"), _nth("o_orderkey", KINDS).alias("report_type"),
        _nth("o_orderkey", STATES).alias("status"), F.array(priority, F.concat(F.lit("status."), F.lower("o_orderstatus"))).alias("codes"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.col("o_orderdate").alias("seen_at"),
        F.array(F.concat(F.lit("Priority: "), "o_orderpriority"), F.concat(F.lit("Status: "), "o_orderstatus"), F.concat(F.lit("plain"), (F.col("o_orderkey") % 3).cast("string"))).alias("labels"), F.col("o_totalprice").alias("price"),
    )


def cache(s: SparkSession, d: str) -> DataFrame:
    rows = tasks(s, d).where("report_type in ('ctv', 'apps')").select("report_type", "codes").distinct()
    size = F.length(F.get("codes", F.lit(0)))
    return rows.select(S.tag_signature("report_type", "codes").alias("signature"), "report_type", "codes", F.lit(0.4).alias("confidence"), *[(size * (i + 3) % 100).cast("double").alias(a) for i, a in enumerate(AXES)])


def resolved(s: SparkSession, d: str) -> DataFrame:
    own = profiles(s, d).select(F.col("user_id").alias("identifier"), F.lit(0.9).alias("confidence"), *AXES)
    return dashboards.resolved(tasks(s, d), own, cache(s, d))


def members(s: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("dev-"), F.col("c_custkey").cast("string"))
    return load(s, d, "customer").select((F.col("c_nationkey") % 5).alias("cohort_id"), key.alias("subject_key"), (F.col("c_custkey") % 9 == 0).alias("holdout"), (F.col("c_acctbal") / 10000).alias("similarity"), F.col("c_custkey").alias("user"))


def records(s: SparkSession, d: str) -> DataFrame:
    state = _nth("o_orderkey", ("scored", "scored", "pending", "failed"))
    day = F.col("o_orderdate")
    return load(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 4).alias("dataset_id"), state.alias("status"), F.concat(F.lit("s"), (F.col("o_custkey") % 60).cast("string")).alias("source_name"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("kpi"), day.alias("created_at"), day.alias("updated_at"))


def source_analyses(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").where("c_custkey % 60 < 40").select(F.concat(F.lit("s"), (F.col("c_custkey") % 60).cast("string")).alias("source_name"), F.col("c_custkey").alias("analysis_id"), F.lit(0).alias("created_at"), _nth("c_custkey", ("grounded", "bridged", "text-only")).alias("grounding_level"))


def web_rows(s: SparkSession, d: str) -> DataFrame:
    page = load(s, d, "pages")
    return page.select(
        F.concat(F.lit("p"), (F.col("page_id") % 40).cast("string")).alias("EID"), F.col("url").alias("Page"), S.host_of("url").alias("Domain"), F.concat(F.lit("WWW.ref"), (F.col("page_id") % 3).cast("string"), F.lit(".org:80/x")).alias("ref"),
        F.concat(F.lit("IAB"), (F.col("page_id") % 9).cast("string"), F.lit("| IAB-7 ,")).alias("iab_codes"), (F.col("page_id") % 30).cast("string").alias("signals"), "page_id",
    )


def visit_rows(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("maid"), F.when(F.col("event_type") != "error", F.concat(F.lit("Brand "), "event_type")).otherwise("nan").alias("BrandName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("d_utc"), F.when(F.col("event_id") % 4 > 0, F.col("value").cast("string")).alias("distance"), "event_id")


def people_rows(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("primary_identifier"), F.concat((F.col("c_nationkey") * 3).cast("string"), F.lit("-99")).alias("Age"), F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") / 1000).cast("int").cast("string")).otherwise("null").alias("income_band"), F.lower("c_mktsegment").alias("Household"))


def app_rows(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "part")
    return p.select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey").cast("string")).alias("hem"), F.col("p_type").alias("CategoryName"), F.col("p_brand").alias("TaxonomyName"), (F.col("p_size") - 5).cast("string").alias("Signals"), F.col("p_size").cast("string").alias("uniques"), F.concat(F.lit("x/activation_id"), (F.col("p_partkey") % 4).cast("string"), F.lit("_s.csv")).alias("key"))


def origin_rows(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "supplier").join(load(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("device_id"), F.lit("Urban Core").alias("origin_type"), F.initcap("n_name").alias("state"), F.when(F.col("s_acctbal") > 5000, "long-haul").alias("travel"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("identifier", "label", F.array_join(F.transform("tags", lambda t: t["code"]), ",").alias("codes"), F.round("confidence", 3).alias("confidence"))


def _cohorts(s: SparkSession, d: str) -> DataFrame:
    return s.range(7).select(F.col("id").alias("cohort_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("slug"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("event_type").alias("metric"), F.col("value"), F.col("user_id").alias("device_id"))


def _calibration(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").select(F.concat(F.lit("k."), (F.col("user_id") % 12).cast("string")).alias("code"), F.col("event_type").alias("category"), "value")
    return e.groupBy("code", "category").agg(F.count("*").alias("n"), F.avg(F.least(F.lit(100.0), F.col("value"))).alias("mean_score"), (F.var_pop("value") * F.count("*")).alias("m2"))


def _subject_tags(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").groupBy(F.col("event_type").alias("subject"), F.concat(F.lit("k."), (F.col("user_id") % 12).cast("string")).alias("code")).agg((F.count("*") / 100).alias("weight"))


def _feedback(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders").where("o_orderkey % 5 = 0").select((F.col("o_custkey") % 50).alias("source_id"), F.lower("o_orderstatus").alias("category"), (F.col("o_orderkey") % 90).alias("predicted"), (F.col("o_orderkey") % 70).alias("corrected"))
    tags = load(s, d, "part").select((F.col("p_partkey") % 50).alias("source_id"), (F.col("p_partkey") % 20).alias("node_id")).distinct()
    return algebra.feedback_bias(o, tags)


def _market(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    live = e.groupBy(F.col("event_type").alias("metric")).agg(S.exact_mean("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("sample"))
    live = live.where("metric <> 'view'").select("metric", F.lit("live").alias("basis"), "mean", "sd", "sample")
    fixed = e.select(F.col("event_type").alias("metric")).distinct().select("metric", F.lit("published").alias("basis"), F.lit(40.0).alias("mean"), F.lit(20.0).alias("sd"), F.lit(10).cast("long").alias("sample"))
    return live.unionByName(fixed)


def _tracks(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").groupBy(F.col("user_id").alias("track"), F.col("event_type").alias("metric")).agg(S.exact_mean("value").alias("value"))


METRIC_WEIGHTS = dict(zip(("error", "click", "purchase", "view", "signup"), (0.3, 0.25, 0.2, 0.15, 0.1)))


def _failures(s: SparkSession, d: str) -> DataFrame:
    codes = (402, 403, 401, 404, 546, 504, 429, 503, 0, 0, 0)
    said = ("", "", "", "", "", "", "slow down retryAfterMs: 20000", "", "column x does not exist", "socket hang up", "odd")
    o = load(s, d, "orders")
    nth = F.when(F.col("o_orderkey") % 11 < 8, _nth("o_orderkey", tuple(map(str, codes)))).cast("int")
    return o.select(F.col("o_orderkey").alias("job_id"), nth.alias("status_code"), F.lit(None).cast("string").alias("code"), _nth("o_orderkey", said).alias("message"), F.when(F.col("o_custkey") % 3 == 0, "scored").when(F.col("o_custkey") % 3 == 1, "unchanged").otherwise("failed").alias("outcome"), (F.col("o_custkey") % 6).alias("attempts"), F.lit(4).alias("max_attempts"), F.lit(1.0).alias("step_scale"))


def _files(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    at = lambda n: F.when(F.col("o_orderkey") % n == 0, F.col("o_orderdate"))
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "processing").otherwise("done").alias("status"), at(3).alias("heartbeat_at"), at(2).alias("started_at"), F.col("o_orderdate").alias("discovered_at"))


def _enqueued(s: SparkSession, d: str) -> DataFrame:
    queue = tasks(s, d).where("id % 3 <> 0").select(F.col("id").cast("string").alias("id"), "status", F.col("report_type").alias("label"), "confidence")
    new = tasks(s, d).where("id % 2 = 0").select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, F.lit("new")).alias("label"), (F.col("confidence") + 1).alias("confidence"))
    return export.enqueue(queue, new, ["id"])


def _staged(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    chunk = e.select(F.lit("f").alias("object_key"), F.floor(F.col("event_id") / 1000).alias("source_offset"), F.lit("p").alias("part_key"), F.concat(F.lit(" u"), (F.col("user_id") % 20).cast("string"), F.lit(" ")).alias("subject"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd HH")).alias("day"), F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 4).cast("string")).alias("weight"))
    empty = s.createDataFrame([], "object_key string, subject string, code string, day date, weight double"), s.createDataFrame([], "object_key string, source_offset long, part_key string")
    first = export.stage_rollups(*empty, chunk.where("source_offset < 3"))
    # All chunks again: those that are known add nothing.
    return export.stage_rollups(*first, chunk)[0]


def _grounded(s: SparkSession, d: str) -> DataFrame:
    base = load(s, d, "embeddings")
    near = vectors.knn_cosine(base.where("label < 5"), base.where("label >= 5 and vec_id % 10 = 0"), 8)
    axis = lambda i: (F.col("vec_id") * (i + 3) % 101).cast("double")
    scores = base.select(F.col("vec_id").alias("id"), *[axis(i).alias(a) for i, a in enumerate(AXES)], F.lit(0.5).alias("confidence"))
    return vectors.rescore_by_neighbours(near, scores, scores)


def _priors(s: SparkSession, d: str) -> DataFrame:
    nodes = load(s, d, "events").select(F.concat(F.lit("k."), (F.col("user_id") % 12).cast("string")).alias("code"), ((F.col("user_id") % 12) / 12).alias("similarity")).distinct()
    named = dict(zip(AXIS_EVENTS, AXES))
    cal = _calibration(s, d)
    cal = cal.withColumn("category", F.coalesce(*[F.when(F.col("category") == e, a) for e, a in named.items()]))
    return vectors.prior_targets(TARGET, nodes, cal)


def _bridged(s: SparkSession, d: str) -> DataFrame:
    v = load(s, d, "embeddings").where("vec_id % 25 = 0")
    wide = v.select("vec_id", vectors.padded("embedding", 96).alias("p"), vectors.folded("embedding", 16).alias("f"))
    nth = lambda c, i: F.round(F.get(c, F.lit(i)), 4)
    return wide.select("vec_id", *[nth("p", i).alias(f"p{i}") for i in (0, 63, 64, 95)], *[nth("f", i).alias(f"f{i}") for i in (0, 15)])


def _weighted(s: SparkSession, d: str) -> DataFrame:
    v = load(s, d, "embeddings").select("label", F.when(F.col("vec_id") % 3 == 0, "audio").otherwise("text").alias("space"), "embedding", (F.col("vec_id") % 4).alias("weight"))
    return _rounded(vectors.weighted_mean(v, "label").where("pos < 3"), "value")


def _meta(s: SparkSession, d: str) -> DataFrame:
    per = profiles(s, d).groupBy((F.col("user_id") % 6).alias("k")).agg(F.count("*").alias("members"), *[F.avg(a).alias(a) for a in AXES])
    return algebra.meta_fingerprint(per.withColumn("confidence", (F.col("k") + 1) / 10))


def _similar(s: SparkSession, d: str) -> DataFrame:
    config = {a: {"weight": w, "bias": b, "enabled": e} for a, w, b, e in zip(AXES, (1, 2, 1, 3, 1, 1), (0, 5, -5, 10, 0, 0), (True, True, True, True, True, False))}
    p = profiles(s, d)
    return p.select("user_id", F.round(algebra.profile_similarity(p, TARGET, config), 4).alias("similarity"))


def _refusals(s: SparkSession, d: str) -> DataFrame:
    rows = members(s, d).groupBy("cohort_id").agg((F.count("*") * 4).alias("members"))
    rows = rows.select(F.concat(F.lit("c"), F.col("cohort_id").cast("string")).alias("slug"), "members", (F.col("cohort_id") != 2).alias("export_eligible"))
    return rows.select("slug", export.refusal(rows).isNull().alias("allowed"))


def _depth(s: SparkSession, d: str) -> DataFrame:
    return dashboards.queue_depth(tasks(s, d), 150)


def _custody(s: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("c_name").cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    c = load(s, d, "customer")
    ip = F.concat(F.lit("10.0."), (F.col("c_custkey") % 200).cast("string"), F.lit(".7"))
    keys = c.select(F.when(F.col("c_custkey") % 50 == 0, uuid).when(F.col("c_custkey") % 70 == 0, ip).when(F.col("c_custkey") % 90 == 0, "fe80::1:2").otherwise(h).alias("key"))
    return dashboards.custody_scan(identifiers=keys, members=c.select(F.col("c_name").alias("key")))


def _routed(s: SparkSession, d: str) -> DataFrame:
    names = ("2024_demographics_acme_ctv_audio_5580.parquet", "2024_apps_report_acme_ctv_1.csv.gz", "x/visitation/part.json", "ctvsignals20240821.parquet", "drop/web_report.csv", "song.MP3", "origin/2024_ctv.parquet", "readme.txt", "a/filelist_keys.json")
    o = load(s, d, "orders").where("o_orderkey < 400")
    rows = o.select("o_orderkey", _nth("o_orderkey", names).alias("key"))
    return rows.select("o_orderkey", delivery.report_type("key").alias("report_type"), delivery.is_audio_key("key").alias("audio"), delivery.is_manifest_key("key").alias("manifest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "delivery_routes": _routed,
    "web_tags": lambda s, d: _shown(normalise.normalise_rows(web_rows(s, d), "web")),
    "visit_tags": lambda s, d: _shown(normalise.normalise_rows(visit_rows(s, d), "visitation")),
    "app_tags": lambda s, d: _shown(normalise.normalise_rows(app_rows(s, d), "apps")),
    "people_tags": lambda s, d: _shown(normalise.normalise_rows(people_rows(s, d), "demographics")),
    "origin_tags": lambda s, d: _shown(normalise.normalise_rows(origin_rows(s, d), "origin")),
    "merged_visits": lambda s, d: (lambda rows: normalise.merge_by_identifier(rows, "event_id").select("identifier", "label", F.size("tags").alias("n_tags"), F.array_join(F.array_sort(F.transform("tags", lambda t: t["code"])), ",").alias("codes"), F.size("signals").alias("n_signals"), "confidence"))(_with_order(visit_rows(s, d), "visitation", "event_id")),
    "summary_tags": lambda s, d: (lambda df: _rounded(normalise.summary_rows(df, delivery.activation_id("key")).select("identifier", "label", F.array_join(F.transform("tags", lambda t: t["code"]), ",").alias("codes"), "share", "confidence"), "share", "confidence"))(app_rows(s, d)),
    "delivery_quality": lambda s, d: quality.rows_per_key(load(s, d, "orders"), "o_custkey", 10.0),
    "csv_contract": lambda s, d: quality.contract_rows(_contract(s, d)).select("external_user_id", "source_name", "emotional", "kpi_ctr", "market", "complete"),
    "signal_coverage": lambda s, d: dashboards.signal_coverage(tasks(s, d).select(F.when(F.col("id") % 11 > 0, F.col("activation_id")).alias("activation_id"), (F.col("status") != "pending").alias("tagged"), (F.col("status") == "done").alias("scored"))),
    "cohort_list": lambda s, d: dashboards.cohort_list(_cohorts(s, d), members(s, d), load(s, d, "orders").select((F.col("o_custkey") % 5).alias("cohort_id"), F.col("o_orderdate").alias("exported_at"))),
    "segment_lift": lambda s, d: dashboards.segment_lift(_metrics(s, d), profiles(s, d).where("emotional > 50").select(F.col("user_id").alias("device_id"))),
    "segment_axes": lambda s, d: dashboards.axis_means(resolved(s, d)),
    "enrichment_status": lambda s, d: dashboards.enrichment_status(tasks(s, d)),
    "enrichment_labels": lambda s, d: dashboards.top_labels(tasks(s, d), most=4),
    "signal_families": lambda s, d: dashboards.signal_families(dashboards.label_parts(tasks(s, d), "labels", "report_type")),
    "signal_axes": lambda s, d: dashboards.signal_axes(dashboards.label_parts(resolved(s, d), "labels", "report_type")),
    "signal_devices": lambda s, d: dashboards.signal_devices(dashboards.label_parts(tasks(s, d).withColumn("id", F.col("identifier")), "labels", "report_type"), "Status", "P", 5, 10),
    "own_data": lambda s, d: dashboards.own_data(records(s, d)),
    "feed_status": lambda s, d: dashboards.feed_status(records(s, d), source_analyses(s, d), "1999-01-01 00:00:00"),
    "identifier_grounding": lambda s, d: resolved(s, d).groupBy("grounding").agg(F.count("*").alias("rows"), F.round(F.avg("confidence"), 4).alias("confidence")),
    "grounding_levels": lambda s, d: dashboards.grounding_levels(source_analyses(s, d).select("grounding_level", F.col("analysis_id").alias("identifier_count"), (F.col("analysis_id") % 2 == 0).alias("has_audio"))),
    "population": lambda s, d: dashboards.population(profiles(s, d)),
    "activation_tags": lambda s, d: dashboards.activation_profile(tasks(s, d), tasks(s, d).select(F.explode("codes").alias("code")).distinct().withColumn("suppressed", F.col("code") == "status.p"), resolved(s, d), 3)[0],
    "activation_axes": lambda s, d: dashboards.activation_profile(tasks(s, d), tasks(s, d).select(F.explode("codes").alias("code"), F.lit(False).alias("suppressed")), profiles(s, d).select(F.col("user_id").alias("identifier"), F.lit(0.8).alias("confidence"), *AXES))[1],
    "dataset_state": lambda s, d: dashboards.dataset_state(tasks(s, d).where("status = 'done' or activation_id <> 'a3'")),
    "cost_estimate": lambda s, d: dashboards.cost_estimate(tasks(s, d), cache(s, d), 5),
    "listener_refresh": lambda s, d: dashboards.listener_profiles(tasks(s, d).select((F.col("identifier") % 150).alias("source_id"), "identifier", (F.col("id") % 3).alias("observations"), F.col("seen_at").alias("last_seen"), F.array_join("codes", ",").alias("tag_codes"), F.col("id").alias("updated_at")), analyses(s, d).select(F.col("user_id").alias("source_id"), *AXES, "confidence", F.lit("grounded").alias("grounding_level"), "created_at", "analysis_id"), s.range(100).select(F.col("id").alias("source_id"), F.lit(True).alias("has_audio"))).select("source_id", "identifier_count", "observation_count", "last_seen", F.round("emotional", 4).alias("emotional"), "confidence", "has_audio"),
    "queue_depth": _depth,
    "custody_scan": _custody,
    "floor_percentiles": lambda s, d: dashboards.floor_percentiles(load(s, d, "events"), "event_type", "value"),
    "user_fingerprints": lambda s, d: algebra.user_fingerprints(analyses(s, d), AS_OF, 10).withColumns({a: F.round(a, 2) for a in AXES}),
    "fingerprint_drift": lambda s, d: algebra.drift(algebra.user_fingerprints(analyses(s, d), AS_OF, 5)).select("user_id", F.round("distance_pct", 2).alias("distance_pct"), "axis", "direction"),
    "speech_damping": lambda s, d: algebra.damp_speech(profiles(s, d).select("user_id", *AXES), 0.5, {"artistic": 1.2}, stages=True).select("user_id", *AXES, "communication_damped", "social_given"),
    "auto_tune": lambda s, d: algebra.auto_tune(profiles(s, d).withColumn("communication", F.col("communication") + 30)),
    "brief_axes": lambda s, d: algebra.spread_ranks(profiles(s, d).select("user_id", *[(F.col(a) / 100).alias(a) for a in AXES])),
    "feedback_bias": lambda s, d: _rounded(_feedback(s, d), "bias", digits=6),
    "tag_attribution": lambda s, d: _rounded(algebra.attribute_tags(_subject_tags(s, d), _calibration(s, d)), "share"),
    "prior_pool": lambda s, d: algebra.pooled_priors(_calibration(s, d)),
    "axis_agreement": lambda s, d: (lambda p: _rounded(algebra.axis_agreement(p, p.withColumns({a: F.col(a) + F.col("user_id") % 20 for a in AXES[:2]}), "user_id"), "max_delta"))(profiles(s, d)),
    "regression_drift": lambda s, d: (lambda p: algebra.regression_drift(p, p.withColumns({a: F.col(a) + F.col("user_id") % (3 * i + 2) for i, a in enumerate(AXES)}), "user_id"))(profiles(s, d)),
    "resonance": lambda s, d: algebra.resonance(profiles(s, d), TARGET, WEIGHTS).select("user_id", "score", "distance", "weakest"),
    "profile_similarity": _similar,
    "market_metrics": lambda s, d: algebra.compare_to_market(_tracks(s, d), _market(s, d), METRIC_WEIGHTS)[0],
    "market_scores": lambda s, d: algebra.compare_to_market(_tracks(s, d), _market(s, d), METRIC_WEIGHTS)[1],
    "meta_fingerprint": _meta,
    "text_fingerprint": lambda s, d: algebra.text_fingerprint(load(s, d, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_size").cast("double").alias("weight")), "p_brand"),
    "grounding_claims": lambda s, d: tasks(s, d).groupBy(algebra.grounding_level(_nth("id", ("CLAP", "", "neighbors", "lyrics")), F.col("id") % 7 == 0, F.col("id") % 5 == 0, F.lit(None).cast("boolean")).alias("level")).agg(F.count("*").alias("n")),
    "activation_file": lambda s, d: export.activation_rows(members(s, d).unionByName(members(s, d))),
    "activation_counts": lambda s, d: export.activation_counts(members(s, d).withColumn("subject_key", F.when(F.col("user") % 10 == 0, F.concat(F.lit("group:"), "subject_key")).otherwise(F.col("subject_key")))),
    "export_refusals": _refusals,
    "exported_activations": lambda s, d: export.exported_activations(members(s, d).withColumn("subject_key", F.col("user")), tasks(s, d)),
    "enqueue_merge": _enqueued,
    "finish_jobs": lambda s, d: export.finish(tasks(s, d).select("id", "status", "confidence"), tasks(s, d).where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.lit("done")).alias("status"), (F.col("confidence") / 2).alias("confidence"))),
    "stage_rollups": _staged,
    "daily_runs": lambda s, d: export.daily_runs(load(s, d, "events"), "user_id", "ts", 20),
    "failure_classes": lambda s, d: lifecycle.classify_failures(_failures(s, d)).groupBy("kind", "retryable", "shrink", "backoff_ms").agg(F.count("*").alias("n")),
    "task_outcomes": lambda s, d: lifecycle.settle(lifecycle.classify_failures(_failures(s, d))),
    "reaped_claims": lambda s, d: lifecycle.reap(_files(s, d), "1996-01-01 00:00:00").select("o_orderkey", "status", "started_at"),
    "queue_positions": lambda s, d: lifecycle.queue_positions(tasks(s, d).select(F.col("id").alias("job_id"), "status", (F.col("id") % 5).alias("priority"), F.col("seen_at").alias("created_at")), 100),
    "purge_cascade": lambda s, d: (lambda o, deps: deps["events"].groupBy("event_type").agg(F.count("*").alias("n")))(*lifecycle.purge_cascade(load(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max("ts").alias("updated_at"), F.max("ts").alias("created_at")), {"events": load(s, d, "events")}, "user_id", "2024-01-31 12:00:00", 1)),
    "weighted_fit": lambda s, d: audience.best_fits(profiles(s, d), TARGET, 20, WEIGHTS, profiles(s, d).where("user_id % 7 = 0").select("user_id")),
    "grounding_rescore": _grounded,
    "prior_targets": _priors,
    "bridged_vectors": _bridged,
    "weighted_vectors": _weighted,
    "seed_profile": lambda s, d: vectors.seed_profile(profiles(s, d).where("user_id < 40")),
    "match_prefix": lambda s, d: vectors.match_one(load(s, d, "embeddings"), [1.0] + [0.5] * 63, 12, where=F.col("label") < 4, exclude=7).select("vec_id", F.round("similarity", 4).alias("similarity")),
    "outcome_intervals": lambda s, d: learning.bootstrap(profiles(s, d).withColumn("kpi", F.col("n") * 1.0), AXES, "kpi", "user_id"),
    "slice_lift": lambda s, d: audience.arms(members(s, d), load(s, d, "orders").select(F.concat(F.lit("dev-"), F.col("o_custkey").cast("string")).alias("subject_key"), F.col("o_totalprice").alias("value"))).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean")),
}


def _with_order(df: DataFrame, kind: str, order: str) -> DataFrame:
    """Normalised rows of one delivery with the column that tells their arrival."""
    return normalise.normalise_rows(df, kind, keep=(order,))


def _contract(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    score = F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 130).cast("string")).otherwise("")
    return o.select(F.col("o_custkey").cast("string").alias("External User Id"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).otherwise(" ").alias("source_name"), *[score.alias(f"{a}_score") for a in AXES], F.concat(F.lit("$1,"), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit("%")).alias("kpi_ctr"), F.col("o_orderstatus").alias("attr_market"))
