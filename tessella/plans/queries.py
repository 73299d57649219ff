"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import audience, insights, learning, lifecycle, profiles, vectors
from tessella.plans import catalogues, controls, details, live, records, reports, reports_sql
from tessella.streaming import ingest

AXES = list(S.AXES)
#: Parameters of the registered audience queries.
TARGET = dict(zip(AXES, (60.0, 55.0, 50.0, 45.0, 50.0, 50.0)))
AS_OF = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.axis_profiles(load(spark, d, "events"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return profiles.filled(_profiles(spark, d))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a job queue."""
    status = F.when(F.col("o_orderstatus") == "F", "processing").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    due = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, cast(o_orderkey % 400 as int))"))
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_custkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("claimed_at"), due.alias("next_attempt_at"),
    )


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a taxonomy, and the quantities ordered of their codes."""
    code = F.lower(F.concat_ws(".", "p_type", "p_brand")).alias("code")
    parts = load(spark, d, "part").select("p_partkey", code, "p_size")
    nodes = parts.groupBy("code").agg(F.max(F.col("p_size") > 45).alias("grounded"))
    lines = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("weight"))
    return nodes, lines.join(parts.select("p_partkey", "code"), "p_partkey").select("code", "weight")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    held = S.is_holdout(F.lit("lift"), F.col("user_id").cast("string"), 0.3)
    per = load(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("value"))
    return per.select(F.when(held, "holdout").otherwise("exposed").alias("arm"), "value")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    event, part = F.concat(F.lit("Type: "), "event_type"), F.concat(F.lit("Daypart: "), S.daypart("ts"))
    return load(spark, d, "events").select(F.col("user_id").alias("device"), F.explode(F.array(event, part)).alias("label"))


def _rekeyed(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("observations"), F.max("ts").alias("last_seen"), F.collect_set("event_type").alias("codes"))
    out = lifecycle.rekey(rows.withColumnRenamed("user_id", "key"), F.floor(F.col("key") / 10))
    return out.select("key", "observations", "last_seen", F.array_join("codes", ",").alias("codes"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all shapes: hex, UUID, base64 with and without padding, groups, blanks and others."""
    h, twice = F.md5(F.col("c_name").cast("binary")), F.base64(F.concat("c_name", "c_name").cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    shapes = [F.col("c_name"), h, uuid, twice, F.regexp_replace(twice, "=+$", ""), F.concat(F.lit("group:"), "c_name"), F.lit("  "), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 24))]
    return load(spark, d, "customer").select("c_custkey", F.element_at(F.array(*shapes), (F.col("c_custkey") % 8 + 1).cast("int")).alias("key"))


def _moments(spark: SparkSession, d: str) -> DataFrame:
    daily = profiles.moments(load(spark, d, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], "value")
    merged = profiles.merged_moments(daily, ["event_type"])
    return _rounded(merged.select("event_type", "n", "mean", F.sqrt(F.col("m2") / (F.col("n") - 1)).alias("sd")), "mean", "sd")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    points = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("point_id"), "ts")
    trail = events.where("event_type = 'click'").select("user_id", "ts")
    return insights.nearest_in_time(points, trail, "user_id", 3600).select("point_id", "at")


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "embeddings")
    return _rounded(vectors.knn_cosine(base, base.where("vec_id % 50 = 0")).select("query_id", "rank", "similarity"), "similarity")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_rollup": lambda s, d: profiles.top_tags(profiles.rollup_tags(profiles.event_tags(load(s, d, "events"))), 5),
    "axis_profiles": lambda s, d: _profiles(s, d).withColumns({a: F.round(a, 8) for a in AXES}),
    "fingerprint_percentiles": lambda s, d: _rounded(profiles.fingerprint_percentiles(_filled(s, d)), *AXES),
    "spread_confidence": lambda s, d: _filled(s, d).select("user_id", F.round(S.spread_confidence(AXES), 4).alias("confidence"), S.leading_axis(AXES).alias("lead")),
    "axis_histogram": lambda s, d: profiles.axis_histogram(_profiles(s, d)),
    "histogram_medians": lambda s, d: _rounded(profiles.histogram_medians(profiles.axis_histogram(_profiles(s, d))), "median"),
    "reach_bands": lambda s, d: profiles.reach_bands(load(s, d, "events")),
    "score_trend": lambda s, d: _rounded(profiles.score_trend(load(s, d, "events")), "score"),
    "audience_insights": lambda s, d: _rounded(profiles.audience_insights(profiles.event_tags(load(s, d, "events"))), "share"),
    "listener_fit_histogram": lambda s, d: audience.fit_histogram(_filled(s, d), TARGET),
    "listener_fit_topk": lambda s, d: _rounded(audience.best_fits(_filled(s, d), TARGET, 20), "fit"),
    "listener_cohort": lambda s, d: _rounded(audience.cohort(_filled(s, d), TARGET, 0.85, "spring"), "fit"),
    "reach_curve": lambda s, d: audience.reach_curve(audience.fit_histogram(_filled(s, d), TARGET)),
    "fingerprint_neighbours": lambda s, d: _rounded(audience.neighbours(_filled(s, d), TARGET, 10), "similarity"),
    "archetype_assign": lambda s, d: audience.archetypes(_filled(s, d)),
    "knn_cosine": _neighbours,
    "family_centroids": lambda s, d: _rounded(vectors.centroids(load(s, d, "embeddings"), "label"), "value"),
    "url_topics": lambda s, d: load(s, d, "pages").select("page_id", S.host_of("url").alias("host"), F.array_join(S.path_topics("url"), ",").alias("topics"), S.slug("url").alias("slug")),
    "daypart_counts": lambda s, d: load(s, d, "events").groupBy(S.daypart("ts").alias("daypart")).agg(F.count("*").alias("n")),
    "tag_signatures": lambda s, d: profiles.event_tags(load(s, d, "events")).groupBy("user_id").agg(F.collect_set("code").alias("codes")).select("user_id", S.tag_signature(F.lit("ctv"), "codes").alias("signature")),
    "export_ids": lambda s, d: _keys(s, d).select("c_custkey", S.export_id("key").alias("eid")),
    "holdout_split": lambda s, d: load(s, d, "customer").select("c_custkey", S.fnv1a("c_name").alias("hash"), S.is_holdout(F.lit("spring"), F.col("c_custkey").cast("string"), 0.1).alias("holdout"), S.pseudonym("c_name").alias("alias")),
    "signal_values": lambda s, d: _rounded(insights.signal_values(_signals(s, d)), "share"),
    "activation_lift": lambda s, d: _rounded(audience.lift(_outcomes(s, d)), "delta", "low", "high", "relative_lift"),
    "calibration_merge": _moments,
    "coverage_by_branch": lambda s, d: _rounded(insights.coverage(*_parts(s, d)), "share"),
    "coverage_gaps": lambda s, d: (lambda n, w: insights.gaps(n, n.where("grounded"), w, 10))(*_parts(s, d)),
    "catalogue_rollup": lambda s, d: _rounded(insights.catalogue_rollup(load(s, d, "region"), load(s, d, "nation"), load(s, d, "customer")), "score"),
    "value_percentiles": lambda s, d: _rounded(insights.percentile_row(load(s, d, "events"), "event_type", "value"), "p50", "p95"),
    "nearest_click": _nearest,
    "text_search": lambda s, d: insights.search(load(s, d, "part"), "small BRAND", "p_name", "p_brand").select("p_partkey", "p_name"),
    "latest_event": lambda s, d: profiles.latest_per_key(load(s, d, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type"),
    "claim_jobs": lambda s, d: lifecycle.claim(_queue(s, d), "1995-06-01 00:00:00", 64),
    "retire_jobs": lambda s, d: lifecycle.retire(_queue(s, d), 3).groupBy("status").agg(F.count("*").alias("n")),
    "retention_purge": lambda s, d: lifecycle.purge(load(s, d, "events"), F.col("ts"), AS_OF, 7).groupBy("event_type").agg(F.count("*").alias("n")),
    "rekey_merge": _rekeyed,
    "keyset_page": lambda s, d: lifecycle.page_after(load(s, d, "events"), "user_id", 20, 15),
    "outcome_moments": lambda s, d: learning.cross_moments(_filled(s, d).withColumn("kpi", F.col("n").cast("double")), AXES[:2], "kpi").select("n", *[F.round(c, 2).alias(c) for c in ("s_one_emotional", "s_emotional_cognitive", "s_cognitive_kpi")]),
    "outcome_drivers": lambda s, d: _rounded(learning.ridge(_filled(s, d).withColumn("kpi", F.col("n").cast("double")), AXES, "kpi", 0.1), "coefficient"),
    "kmeans_cohorts": lambda s, d: learning.kmeans_cohorts(load(s, d, "embeddings"), 8),
    "stream_rollup": ingest.stream_rollup,
    "stream_windows": lambda s, d: _rounded(ingest.stream_windows(s, d), "score"),
    "stream_distinct": lambda s, d: ingest.stream_distinct(s, d).groupBy("event_type").agg(F.count("*").alias("n")),
}

_PROFILE = "(SELECT user_id, " + ", ".join(f"least(100.0, avg(value) FILTER (WHERE event_type = '{e}')) AS {a}" for a, e in zip(AXES, profiles.AXIS_EVENTS)) + f", least(100.0, avg(value)) AS {AXES[-1]}, least(1.0, count(*) / 100) AS confidence, count(*) AS n FROM events GROUP BY user_id)"
_FILLED = "(SELECT user_id, " + ", ".join(f"coalesce({a}, 50.0) AS {a}" for a in AXES) + f", confidence, n FROM {_PROFILE})"
_TAGS = "(SELECT user_id, 'type.' || event_type AS code, ts::DATE AS day FROM events UNION ALL SELECT user_id, 'k.' || (json_extract(props, '$.k')::INT // 10), ts::DATE FROM events WHERE json_extract(props, '$.k') IS NOT NULL)"
_FIT = "greatest(0.0, least(1.0, 1 - (" + " + ".join(f"abs({a} - {TARGET[a]})" for a in AXES) + ") / 600.0))"
_HIST = f"(SELECT least(floor(round({_FIT} * 100, 6)), 100)::INT + 1 AS bucket, count(*) AS users FROM {_FILLED} GROUP BY 1)"
_BINS = f"(SELECT axis, least(floor(score / 10), 9)::INT AS bin, count(*) AS n FROM (UNPIVOT {_PROFILE} ON {', '.join(AXES)} INTO NAME axis VALUE score) GROUP BY 1, 2)"
_LEAD = "CASE " + " ".join(f"WHEN {a} = greatest({', '.join(AXES)}) THEN '{a}'" for a in AXES) + " END"
_DAYPART = "CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 22 THEN 'primetime' ELSE 'latenight' END"
_FNV = lambda x: f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)"
_PARTS = "(SELECT p_partkey, lower(p_type || '.' || p_brand) AS code, p_size FROM part)"
_NODES = f"(SELECT code, max(p_size > 45) AS grounded FROM {_PARTS} GROUP BY code)"
_WEIGHTS = f"(SELECT code, l_quantity AS weight FROM lineitem JOIN {_PARTS} ON l_partkey = p_partkey)"
_QUEUE = "(SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'processing' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_custkey % 4 AS attempts, o_orderdate AS created_at, o_orderdate AS claimed_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + to_days((o_orderkey % 400)::INT) END AS next_at FROM orders)"
_DIST = {n: "round(sqrt(" + " + ".join(f"({a} - {float(x)}) * ({a} - {float(x)})" for a, x in zip(AXES, xs)) + "), 6)" for n, xs in audience.ARCHETYPES.items()}
_DOT = " + ".join(f"{a} * {TARGET[a]}" for a in AXES)
_SQ = " + ".join(f"{a} * {a}" for a in AXES)
_TSQ = sum(x * x for x in TARGET.values())
_EUC = " + ".join(f"({a} - {TARGET[a]}) * ({a} - {TARGET[a]})" for a in AXES)

ORACLE_SQL: dict[str, str] = {
    "event_rollup": f"SELECT * FROM (SELECT user_id, code, count(*) AS weight, count(DISTINCT day) AS days, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, code) AS rank FROM {_TAGS} GROUP BY user_id, code) WHERE rank <= 5",
    "axis_profiles": f"SELECT user_id, {', '.join(f'round({a}, 8) AS {a}' for a in AXES)}, confidence, n FROM {_PROFILE}",
    "fingerprint_percentiles": f"WITH p AS {_FILLED}, m AS (SELECT {', '.join(f'avg({a}) AS m_{a}, stddev_samp({a}) AS s_{a}' for a in AXES)} FROM p) SELECT user_id, "
    + ", ".join(f"round(CASE WHEN coalesce(s_{a}, 1) < 0.01 THEN 50 ELSE greatest(0, least(100, 100 / (1 + exp(-1.7 * ({a} - m_{a}) / coalesce(s_{a}, 1))))) END, 4) AS {a}" for a in AXES) + " FROM p, m",
    "spread_confidence": f"SELECT user_id, round(greatest(0.1, least(1.0, list_stddev_pop([{', '.join(AXES)}]) / 30)), 4) AS confidence, {_LEAD} AS lead FROM {_FILLED}",
    "axis_histogram": f"SELECT * FROM {_BINS}",
    "histogram_medians": f"SELECT axis, round(bin * 10 + 10 * (half - run + n) / n, 4) AS median FROM (SELECT *, sum(n) OVER (PARTITION BY axis ORDER BY bin) AS run, sum(n) OVER (PARTITION BY axis) / 2 AS half FROM {_BINS}) WHERE run >= half AND run - n < half",
    "reach_bands": "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 100 THEN '21-100' ELSE '100+' END AS band, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1",
    "score_trend": "SELECT b::DATE AS bucket, count(e.ts) AS n, round(avg(value), 4) AS score FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS b FROM events) LEFT JOIN events e ON e.ts::DATE = b::DATE GROUP BY b",
    "audience_insights": f"SELECT * FROM (SELECT split_part(code, '.', 1) AS family, code, users, round(users / sum(users) OVER (PARTITION BY split_part(code, '.', 1)), 4) AS share, row_number() OVER (PARTITION BY split_part(code, '.', 1) ORDER BY users DESC, code) AS rank FROM (SELECT code, count(DISTINCT user_id) AS users FROM {_TAGS} GROUP BY code)) WHERE rank <= 5",
    "listener_fit_histogram": f"SELECT * FROM {_HIST}",
    "listener_fit_topk": f"SELECT user_id, round(fit, 4) AS fit, lead FROM (SELECT user_id, round({_FIT}, 6) AS fit, {_LEAD} AS lead FROM {_FILLED} ORDER BY fit DESC, user_id LIMIT 20)",
    "listener_cohort": f"SELECT user_id, round(fit, 4) AS fit, {_FNV(chr(39) + 'spring:' + chr(39) + ' || user_id')} % 1000 < 100 AS holdout FROM (SELECT user_id, round({_FIT}, 6) AS fit FROM {_FILLED}) WHERE fit >= 0.85",
    "reach_curve": f"WITH h AS {_HIST}, t AS (SELECT DISTINCT ceil(a + (b - a) * i / 11)::BIGINT AS threshold FROM (SELECT min(bucket) AS a, max(bucket) AS b FROM h), range(12) r(i)) SELECT threshold, sum(users)::BIGINT AS reach FROM t JOIN h ON bucket >= threshold GROUP BY threshold",
    "fingerprint_neighbours": f"SELECT user_id, round(s, 4) AS similarity, CASE " + " ".join(f"WHEN {a} + {TARGET[a]} = greatest({', '.join(f'{b} + {TARGET[b]}' for b in AXES)}) THEN '{a}'" for a in AXES) + f" END AS top_shared FROM (SELECT *, round(pow(greatest(0, 0.3 * CASE WHEN {_SQ} > 0 THEN ({_DOT}) / (sqrt({_SQ}) * sqrt({_TSQ})) ELSE 0 END + 0.7 * (1 - sqrt({_EUC}) / sqrt(60000))), 1.5), 6) AS s FROM {_FILLED} ORDER BY s DESC, user_id LIMIT 10)",
    "archetype_assign": f"SELECT user_id, CASE " + " ".join(f"WHEN {d} = least({', '.join(_DIST.values())}) THEN '{n}'" for n, d in _DIST.items()) + f" END AS archetype, least({', '.join(_DIST.values())}) AS distance FROM {_FILLED}",
    "knn_cosine": "SELECT query_id, rank, round(s, 4) AS similarity FROM (SELECT q.vec_id AS query_id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
    "family_centroids": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY 1, 2) SELECT label, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 4) AS value FROM m",
    "daypart_counts": f"SELECT {_DAYPART} AS daypart, count(*) AS n FROM events GROUP BY 1",
    "tag_signatures": f"SELECT user_id, sha256('ctv|' || string_agg(code, ',' ORDER BY code)) AS signature FROM (SELECT DISTINCT user_id, code FROM {_TAGS}) GROUP BY user_id",
    "export_ids": "WITH k AS (SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS h, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN md5(c_name) WHEN 2 THEN substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21) WHEN 3 THEN base64(encode(c_name || c_name)) WHEN 4 THEN rtrim(base64(encode(c_name || c_name)), '=') WHEN 5 THEN 'group:' || c_name WHEN 6 THEN '  ' ELSE substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9) END AS key, hex(encode(c_name || c_name)) AS x FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 8 IN (1, 2) THEN upper(m) WHEN c_custkey % 8 IN (3, 4) THEN substr(x, 1, 32) WHEN c_custkey % 8 IN (0, 7) THEN upper(substr(sha256(key), 1, 32)) END AS eid FROM k",
    "signal_values": f"WITH l AS (SELECT user_id, 'Type' AS family, event_type AS value FROM events UNION ALL SELECT user_id, 'Daypart', {_DAYPART} FROM events) SELECT family, value, devices, round(devices / t, 4) AS share FROM (SELECT family, value, count(DISTINCT user_id) AS devices FROM l GROUP BY 1, 2) JOIN (SELECT family, count(DISTINCT user_id) AS t FROM l GROUP BY 1) USING (family)",
    "activation_lift": f"WITH o AS (SELECT {_FNV(chr(39) + 'lift:' + chr(39) + ' || user_id')} % 1000 < 300 AS h, avg(value) AS v FROM events GROUP BY user_id), s AS (SELECT count(*) FILTER (NOT h) AS n_exposed, count(*) FILTER (h) AS n_holdout, avg(v) FILTER (NOT h) AS me, avg(v) FILTER (h) AS mh, var_samp(v) FILTER (NOT h) AS ve, var_samp(v) FILTER (h) AS vh FROM o) SELECT n_exposed, n_holdout, CASE WHEN ok THEN round(me - mh, 4) END AS delta, CASE WHEN ok THEN round(me - mh - hw, 4) END AS low, CASE WHEN ok THEN round(me - mh + hw, 4) END AS high, CASE WHEN ok THEN round((me - mh) / abs(mh), 4) END AS relative_lift FROM (SELECT *, n_exposed >= 5 AND n_holdout >= 5 AS ok, 1.96 * sqrt(ve / n_exposed + vh / n_holdout) AS hw FROM s)",
    "calibration_merge": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM events GROUP BY 1",
    "coverage_by_branch": f"SELECT split_part(code, '.', 1) AS branch, count(*) AS nodes, count(*) FILTER (grounded) AS grounded, coalesce(sum(weight), 0) AS weight, round(count(*) FILTER (grounded) / count(*), 4) AS share FROM {_NODES} LEFT JOIN (SELECT code, sum(weight) AS weight FROM {_WEIGHTS} GROUP BY 1) USING (code) GROUP BY 1",
    "coverage_gaps": f"SELECT code, sum(weight) AS weight FROM {_WEIGHTS} WHERE code IN (SELECT code FROM {_NODES} WHERE NOT grounded) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "catalogue_rollup": "SELECT 'nation' AS level, n_name AS name, count(*) AS members, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name UNION ALL SELECT 'region', r_name, count(*), round(avg(c_acctbal), 4) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name",
    "value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS top FROM events GROUP BY 1",
    "nearest_click": "SELECT p.event_id AS point_id, arg_min(c.ts, (abs(epoch_us(p.ts) - epoch_us(c.ts)), c.ts)) AS at FROM events p LEFT JOIN events c ON p.user_id = c.user_id AND c.event_type = 'click' AND abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 3600000000 WHERE p.event_type = 'purchase' GROUP BY 1",
    "text_search": "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'small') OR contains(lower(p_brand), 'small')) AND (contains(lower(p_name), 'brand') OR contains(lower(p_brand), 'brand'))",
    "latest_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "claim_jobs": f"SELECT job_id, attempts + 1 AS attempts FROM {_QUEUE} WHERE attempts < 3 AND (status = 'pending' AND (next_at IS NULL OR next_at <= TIMESTAMP '1995-06-01') OR status = 'processing' AND claimed_at < TIMESTAMP '1995-06-01' - INTERVAL 5 MINUTE) ORDER BY CASE status WHEN 'processing' THEN 0 ELSE 1 END, created_at, job_id LIMIT 64",
    "retire_jobs": f"SELECT CASE WHEN status = 'failed' AND attempts >= 3 THEN 'dead_letter' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, count(*) AS n FROM {_QUEUE} GROUP BY 1",
    "retention_purge": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1",
    "rekey_merge": "SELECT user_id // 10 AS key, count(*) AS observations, max(ts) AS last_seen, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS codes FROM events GROUP BY 1",
    "keyset_page": "SELECT DISTINCT user_id FROM events WHERE user_id > 20 ORDER BY 1 LIMIT 15",
    "outcome_moments": f"SELECT count(*) AS n, round(sum(emotional), 2) AS s_one_emotional, round(sum(emotional * cognitive), 2) AS s_emotional_cognitive, round(sum(cognitive * n), 2) AS s_cognitive_kpi FROM {_FILLED}",
    "stream_rollup": f"SELECT user_id, code, day, count(*) AS weight FROM {_TAGS} GROUP BY ALL",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 4) AS score FROM events GROUP BY 1, 2",
    "stream_distinct": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "url_topics": f"SELECT page_id, {reports_sql.HOST('url')} AS host, coalesce(array_to_string(topics, ','), '') AS topics, {reports_sql.SLUG('url')} AS slug FROM pages LEFT JOIN {reports_sql.TOPICS('page_id', 'url', 'pages')} ON page_id = k",
    "holdout_split": f"SELECT c_custkey, h::BIGINT AS hash, {_FNV(chr(39) + 'spring:' + chr(39) + ' || c_custkey')} % 1000 < 100 AS holdout, 'SIG-' || " + " || ".join(f"substr('{S.BASE32}', (h // {32**i} % 32)::INT + 1, 1)" for i in range(5, -1, -1)) + f" AS alias FROM (SELECT c_custkey, {_FNV('c_name')} AS h FROM customer)",
}

QUERIES |= reports.QUERIES | catalogues.QUERIES | controls.QUERIES | live.QUERIES | records.QUERIES | details.QUERIES
ORACLE_SQL |= reports_sql.ORACLE_SQL | catalogues.ORACLE_SQL | controls.ORACLE_SQL | live.ORACLE_SQL | records.ORACLE_SQL | details.ORACLE_SQL
#: Other ways to the same rows.
ORACLE_SQL |= {"indexed_neighbours": ORACLE_SQL["knn_cosine"], "streamed_beacons": ORACLE_SQL["beacons"]}
_SLUG = "'cohort-' || CASE WHEN cohort < 26 THEN chr(97 + cohort::INT) ELSE (cohort + 1)::VARCHAR END"
ORACLE_SQL["cohort_members"] = f"SELECT cohort, slug, count(*) AS n, count(*) FILTER ({_FNV('slug || chr(58) || c_custkey')} % 1000 < 100) AS held FROM (SELECT c_custkey, c_custkey % 30 AS cohort, {_SLUG} AS slug FROM customer WHERE c_custkey % 10 > 0) GROUP BY 1, 2"
_TERMS = ["1", *AXES]
_NORMAL = ", ".join("[" + ", ".join([f"sum({a} * {b})::DOUBLE" + (" + 0.1 * count(*)" if a == b != "1" else "") for b in _TERMS] + [f"sum({a} * n)::DOUBLE"]) + "]" for a in _TERMS)
#: The normal equations, solved by elimination column after column.
ORACLE_SQL["outcome_drivers"] = f"""WITH RECURSIVE s AS (SELECT [{_NORMAL}] AS m FROM {_FILLED}),
  r AS (SELECT 1 AS k, m FROM s UNION ALL SELECT k + 1, list_transform(m, lambda v, i: CASE WHEN i = k THEN list_transform(v, lambda x: x / v[k]) ELSE list_transform(v, lambda x, j: x - m[k][j] * v[k] / m[k][k]) END) FROM r WHERE k <= {len(_TERMS)})
  SELECT unnest(['intercept', '{"', '".join(AXES)}']) AS term, round(unnest(list_transform(m, lambda v: v[{len(_TERMS) + 1}])), 4) AS coefficient FROM r WHERE k = {len(_TERMS) + 1}"""
