"""Registered queries on settings, JSON columns, cohorts and impact, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import documents
from tessella.functions import scalars as S
from tessella.operators import algebra, catalogue, cohorts, control, dashboards, insights, learning, lifecycle
from tessella.plans.reports import AXES, _nth, load, people_rows, profiles, tasks
from tessella.plans.reports import cache as cached_scores
from tessella.plans.reports_sql import AXES as SQL_AXES
from tessella.plans.reports_sql import C, LEAD, P, T, each, nth
from tessella.sources import normalise

TIERS = {"librosa": 1.0, "provider": 0.8, "neighbors": 0.6, "none": 0.4}
RULES = (("(?i)view|click", {"emotional": 5, "social": -3}), ("(?i)purchase", {"cognitive": 8}), ("(?i)err", {"artistic": -60}))


def settings(s: SparkSession, d: str) -> DataFrame:
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    value = F.element_at(F.array((i % 40 - 5).cast("string"), F.lit("true"), F.lit('"a"'), F.lit('"z"'), F.lit("maybe")), (i % 5 + 1).cast("int"))
    bounds = F.when(i % 3 == 0, '{"min": 0, "max": 20}').when(i % 3 == 1, '{"options": ["a", "b"]}')
    return o.select(i.alias("key"), _nth("o_custkey", ("number", "boolean", "enum", "text")).alias("value_type"), value.alias("value"), bounds.alias("bounds"))


def documents_of(s: SparkSession, d: str) -> DataFrame:
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    tags = F.when(i % 4 == 0, F.concat(F.lit('["x", {"code": "c'), (i % 6).cast("string"), F.lit('"}, {"label": "L", "code": "k"}]'))).when(i % 4 == 1, '{"a": 1}').when(i % 4 == 2, "[]")
    return o.select(i.alias("id"), tags.alias("tags"), F.format_string('{"a": %d, "b": "%s", "c": "x%d"}', i % 9, (i % 50 / 10).cast("string"), i % 3).alias("pairs"), F.when(i % 3 == 0, F.format_string("[%d, 1.5]", i)).when(i % 3 == 1, "[]").otherwise("[1, x]").alias("vector"), "o_orderpriority")


def points(s: SparkSession, d: str) -> DataFrame:
    return profiles(s, d).select(F.col("user_id").alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("signature"), F.lit(0.5).alias("confidence"), *AXES)


def tilted(s: SparkSession, d: str) -> DataFrame:
    labels = load(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("labels"))
    score = F.struct(*[((F.col("user_id") * (i + 2)) % 80).cast("double").alias(a) for i, a in enumerate(AXES)], F.lit(0.8).alias("confidence"))
    rows = labels.select("user_id", "labels", F.when(F.col("user_id") % 3 == 0, score).alias("own"), F.when(F.col("user_id") % 3 == 1, score).alias("inherited"))
    return cohorts.signal_points(rows, RULES).select("user_id", *AXES, F.round("confidence", 4).alias("confidence"), "basis")


def faceted(s: SparkSession, d: str) -> DataFrame:
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    blob = F.when(i % 2 == 0, F.format_string('{"activation_id": "%d", "scope": "home_page", "rows": [{"CategoryName": "", "GenreName": "Drama %d"}, {"Name": "drama %d", "Daypart": "night", "AppName": "App"}]}', i % 4, i % 3, i % 3))
    rows = o.select("o_orderkey", blob.alias("ctv"), F.array(F.lit("ctv.genre.drama-1"), F.lit("app.x.app"), F.lit("")).alias("tag_codes"))
    return rows.select("o_orderkey", F.array_join(F.transform(cohorts.facets(rows, {"ctv": "ctv"}), lambda f: F.concat_ws("=", f["kind"], f["label"])), "|").alias("facets"))


def _impact(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").select(F.col("event_type").alias("metric"), "value", F.col("user_id").alias("device_id"))
    p = profiles(s, d)
    return cohorts.tag_impact(e, p.withColumnRenamed("user_id", "device_id"), p.withColumnRenamed("user_id", "id"), "click", 5, 60)[2]


def _rescored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    queue = tasks(s, d).withColumns({"attempts": F.col("id") % 6, "max_attempts": F.lit(3)})
    return control.rescored(queue, cached_scores(s, d), queue.where("id % 400 = 0").select("id"), True)


def _coverage(s: SparkSession, d: str) -> DataFrame:
    part = load(s, d, "part").groupBy(F.lower("p_type").alias("branch")).agg((F.count_if(F.col("p_size") > 40) / F.count("*") * 100).alias("pct"))
    return control.nudges(part, 120, 3, 40.0)


def _default(s: SparkSession, d: str) -> DataFrame:
    runs = load(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("purged"), F.col("o_orderdate").alias("at"))
    some = dashboards.last_or_default(runs, {"purged": 0}, F.desc("at"), F.desc("run_id"))
    return some.unionByName(dashboards.last_or_default(runs.where("run_id < 0"), {"purged": 0}, F.desc("at")))


def _saved(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("confidence"), F.col("o_orderpriority").alias("source_name"))
    return control.saved(rows, "confidence_desc", 90, "1996-01-01 00:00:00").limit(15).select("analysis_id", "confidence")


def _versions(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "part")
    row = lambda k: p.select((F.col("p_partkey") % 20).alias("profile"), F.element_at(F.array(*[F.lit(a) for a in AXES]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("axis"), F.lit("l").alias("label"), (F.col("p_partkey") % k + 1).cast("double").alias("weight"), F.lit(0.0).alias("bias"), (F.col("p_partkey") % 7 > 0).alias("enabled"), "p_partkey").where("p_partkey < 60").drop("p_partkey")
    return algebra.profile_changes(row(5), row(4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "setting_problems": lambda s, d: settings(s, d).select("key", control.setting_problem().alias("problem")),
    "setting_audit": lambda s, d: (lambda x: control.audit(x.where("key % 4 > 0").withColumn("value", F.when(F.col("key") % 6 > 0, F.col("value"))), x.withColumn("value", F.when(F.col("key") % 12 > 0, F.col("value")))))(settings(s, d)),
    "json_elements": lambda s, d: documents_of(s, d).select("id", F.explode(documents.elements("tags")).alias("e")).select("id", documents.tag_text(F.col("e")).alias("tag")),
    "json_numbers": lambda s, d: documents.numeric_pairs(documents_of(s, d), "pairs", "id"),
    "json_vectors": lambda s, d: documents_of(s, d).select("id", F.round(F.get(documents.parse_vector("vector"), F.lit(0)), 3).alias("first")),
    "json_rows": lambda s, d: documents.assembled(load(s, d, "nation"), ["n_regionkey"], "nations", [F.col("n_name")], ["n_nationkey", "n_name"]),
    "json_object": lambda s, d: documents.keyed(tasks(s, d).groupBy("status").agg(F.count("*").alias("n")), "status", "n", "counts"),
    "rescored_queue": lambda s, d: _rescored(s, d)[0].groupBy("status", "max_attempts").agg(F.count("*").alias("n")),
    "rescored_cache": lambda s, d: _rescored(s, d)[1].select("signature", "report_type"),
    "nudges": _coverage,
    "agent_spending": lambda s, d: control.spent(load(s, d, "orders").select(_nth("o_orderkey", ("agent", "human")).alias("source"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderkey") % 5 > 0, F.format_string('{"usd": %d.25}', F.col("o_orderkey") % 7)).alias("proposal")), "1997-01-01 00:00:00", 24 * 30),
    "saved_analyses": _saved,
    "last_or_default": _default,
    "confidence_parts": lambda s, d: cohorts.confidence_parts(profiles(s, d).withColumn("confidence", F.col("user_id") % 11 / 10), TIERS).select("user_id", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("factor", 4).alias("factor"), "tier"),
    "signal_points": tilted,
    "signal_facets": faceted,
    "signal_clusters": lambda s, d: cohorts.cluster_signals(points(s, d), 6),
    "cohort_summary": lambda s, d: (lambda p: cohorts.cohort_summary(p, p.select("id", (F.col("id") % 4).alias("cohort"))).select("cohort", "members", F.round("share", 4).alias("share"), F.round("cohesion", 4).alias("cohesion"), "lead", *[F.round(a, 4).alias(a) for a in AXES], "avg_confidence"))(points(s, d)),
    "cohort_members": lambda s, d: cohorts.cohort_members(load(s, d, "customer").select(F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey").cast("string")).otherwise("group:1").alias("id"), (F.col("c_custkey") % 30).cast("int").alias("cohort"))).groupBy("cohort", "slug").agg(F.count("*").alias("n"), F.count_if("holdout").alias("held")),
    "tag_impact": _impact,
    "content_hashes": lambda s, d: load(s, d, "nation").select("n_nationkey", S.content_hash("n_nationkey", "n_name").alias("hash"), S.leaf_label(F.concat(F.lit("a.b."), F.lower("n_name"))).alias("leaf")),
    "trend_buckets": lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(S.time_bucket(F.min("o_orderdate"), F.max("o_orderdate")).alias("bucket"), S.hours_between(F.max("o_orderdate"), F.min("o_orderdate")).alias("hours")),
    "optional_filters": lambda s, d: load(s, d, "events").where(catalogue.optional("event_type", "click") & catalogue.optional("user_id", None)).groupBy("event_type").agg(F.count("*").alias("n")),
    "any_tag": lambda s, d: tasks(s, d).where(F.arrays_overlap("codes", F.array(F.lit("status.p"), F.lit("1-urgent")))).groupBy("status").agg(F.count("*").alias("n")),
    "profile_changes": lambda s, d: _versions(s, d).withColumns({c: F.round(c, 6) for c in ("influence_before", "influence_after")}),
    "feature_hints": lambda s, d: algebra.feature_hints(profiles(s, d), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("user_id") % 5 / 2).select("user_id", F.round("tempo", 4).alias("tempo"), F.round("centroid_hz", 4).alias("centroid_hz"), F.round("energy", 4).alias("energy")),
    "predicted_outcomes": lambda s, d: learning.predicted_outcomes(profiles(s, d), load(s, d, "events").select("user_id", "value"), AXES, least=5, draws=40)[1],
    "batch_status": lambda s, d: lifecycle.batch_status(load(s, d, "orders").select((F.col("o_custkey") % 90).alias("batch_id"), F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("scored").alias("outcome"))),
    "sweep_candidates": lambda s, d: lifecycle.sweep_candidates(load(s, d, "orders").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") % 3 > 0).alias("has_vector"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")).alias("checked_at")), "1996-01-01 00:00:00", 50, 200).select("source_id"),
    "mapping_report": lambda s, d: normalise.inspected(people_rows(s, d), "demographics", "primary_identifier").groupBy("field", "column").agg(F.count("*").alias("rows"), F.count("value").alias("values")),
    "folded_words": lambda s, d: load(s, d, "part").select("p_partkey", insights.folded(F.concat(F.lit("  ÉCOLE  "), "p_name")).alias("words")),
}

_SET = "(SELECT o_orderkey AS key, ['number', 'boolean', 'enum', 'text'][o_custkey % 4 + 1] AS t, o_orderkey % 5 AS v, o_orderkey % 40 - 5 AS n, o_orderkey % 3 AS b, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 40 - 5)::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN '\"a\"' WHEN 3 THEN '\"z\"' ELSE 'maybe' END AS value FROM orders)"
_PT = f"(SELECT user_id AS id, user_id % 4 AS cohort, {', '.join(SQL_AXES)} FROM {P})"
ORACLE_SQL: dict[str, str] = {
    "setting_problems": f"SELECT key, CASE t WHEN 'number' THEN CASE WHEN v > 0 THEN 'expects a number' WHEN b = 0 AND n < 0 THEN 'below min' WHEN b = 0 AND n > 20 THEN 'above max' END WHEN 'boolean' THEN CASE WHEN v <> 1 THEN 'expects a boolean' END WHEN 'enum' THEN CASE WHEN b = 1 AND v <> 2 THEN 'not an allowed option' END END AS problem FROM {_SET}",
    "setting_audit": f"SELECT key, CASE WHEN key % 4 > 0 AND key % 6 > 0 THEN value END AS old_value, CASE WHEN key % 12 > 0 THEN value END AS new_value FROM {_SET} WHERE key % 4 = 0 OR (CASE WHEN key % 6 > 0 THEN value END) IS DISTINCT FROM (CASE WHEN key % 12 > 0 THEN value END)",
    "json_elements": "SELECT o_orderkey AS id, unnest(['x', 'c' || (o_orderkey % 6), 'L']) AS tag FROM orders WHERE o_orderkey % 4 = 0",
    "json_numbers": "SELECT o_orderkey AS id, unnest(['a', 'b']) AS key, unnest([o_orderkey % 9, o_orderkey % 50 / 10]) AS number FROM orders",
    "json_vectors": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::DOUBLE END AS first FROM orders",
    "json_rows": """SELECT n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_name) || ']' AS nations FROM nation GROUP BY 1""",
    "json_object": f"""SELECT '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS counts FROM (SELECT status, count(*) AS n FROM {T} GROUP BY 1)""",
    "rescored_queue": f"SELECT CASE WHEN id % 400 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 400 = 0 THEN greatest(3, id % 6 + 3) ELSE 3 END AS max_attempts, count(*) AS n FROM {T} GROUP BY 1, 2",
    "rescored_cache": f"SELECT signature, report_type FROM {C} WHERE signature NOT IN (SELECT signature FROM {T} WHERE id % 400 = 0)",
    "nudges": "WITH c AS (SELECT lower(p_type) AS b, count(*) FILTER (p_size > 40) / count(*) * 100 AS pct FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 1) SELECT 'backlog' AS id, 120.0 AS metric, 25.0 AS threshold, 'critical' AS severity, 'run' AS action UNION ALL SELECT 'stale', 40.0, 36.0, 'warn', 'run' UNION ALL SELECT 'coverage', round(pct, 1), 60.0, CASE WHEN pct < 30 THEN 'critical' ELSE 'warn' END, 'run' FROM c WHERE pct < 60",
    "agent_spending": "SELECT coalesce(sum(o_orderkey % 7 + 0.25) FILTER (o_orderkey % 5 > 0), 0) AS usd FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1997-01-01' - INTERVAL 720 HOUR",
    "saved_analyses": "SELECT o_orderkey AS analysis_id, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS confidence FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' - INTERVAL 90 DAY ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15",
    "last_or_default": "(SELECT o_orderkey AS run_id, o_custkey AS purged, o_orderdate AS at FROM orders ORDER BY 3 DESC, 1 DESC LIMIT 1) UNION ALL SELECT NULL, 0, NULL",
    "confidence_parts": f"SELECT user_id, round(m, 4) AS mean, round(sd, 4) AS sd, round(f, 4) AS factor, CASE least(round(abs(f - 1.0), 9), round(abs(f - 0.8), 9), round(abs(f - 0.6), 9), round(abs(f - 0.4), 9)) WHEN round(abs(f - 1.0), 9) THEN 'librosa' WHEN round(abs(f - 0.8), 9) THEN 'provider' WHEN round(abs(f - 0.6), 9) THEN 'neighbors' ELSE 'none' END AS tier FROM (SELECT *, user_id % 11 / 10 / greatest(0.1, least(1.0, sd / 30)) AS f FROM (SELECT user_id, list_avg(v) AS m, list_stddev_pop(v) AS sd FROM (SELECT user_id, [{', '.join(SQL_AXES)}] AS v FROM {P})))",
    "signal_points": f"""WITH l AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('view', 'click')) AS a, max((event_type = 'purchase')::INT) AS b, max((event_type = 'error')::INT) AS e FROM events GROUP BY 1), t AS (SELECT *, CASE WHEN user_id % 3 = 2 THEN NULL ELSE user_id END AS k, (user_id % 3 > 0)::INT AS z FROM l)
      SELECT user_id, {each(lambda n, i: f"greatest(0.0, least(100.0, coalesce(k * {i + 2} % 80, 50) + z * ({dict(emotional='5 * a', social='-3 * a', cognitive='8 * b', artistic='-60 * e').get(n, '0')}))) AS {n}")}, round(CASE WHEN z = 0 THEN 0.8 ELSE greatest(0.05, least(0.9, CASE WHEN k IS NULL THEN 0.15 ELSE 0.8 END * CASE WHEN a + b + e > 0 THEN 0.75 ELSE 0.4 END)) END, 4) AS confidence, ['scored', 'inherited', 'facet-only'][user_id % 3 + 1] AS basis FROM t""",
    "signal_facets": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'activation=Activation ' || (o_orderkey % 4) || '|scope=home page|ctv=Drama ' || (o_orderkey % 3) || '|ctv=night|ctv=App' || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE '|ctv=drama 1' END || '|app=app' ELSE 'ctv=drama 1|app=app' END AS facets FROM orders",
    "cohort_summary": f"WITH p AS {_PT}, c AS (SELECT cohort, count(*) AS members, {each(lambda a, i: f'avg({a}) AS {a}')} FROM p GROUP BY 1), f AS (SELECT p.cohort, avg(sqrt({each(lambda a, i: f'(p.{a} - c.{a}) ** 2', ' + ')})) AS far FROM p JOIN c USING (cohort) GROUP BY 1) SELECT cohort, members, round(members / (SELECT count(*) FROM p), 4) AS share, round(greatest(0, 1 - far / sqrt(60000)), 4) AS cohesion, {LEAD(SQL_AXES)} AS lead, {each(lambda a, i: f'round({a}, 4) AS {a}')}, 0.5 AS avg_confidence FROM c JOIN f USING (cohort)",
    "content_hashes": """SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS hash, replace(replace(lower(n_name), '-', ' '), '_', ' ') AS leaf FROM nation""",
    "trend_buckets": "SELECT o_custkey, CASE WHEN date_diff('day', min(o_orderdate), max(o_orderdate)) <= 45 THEN 'day' WHEN date_diff('day', min(o_orderdate), max(o_orderdate)) <= 180 THEN 'week' ELSE 'month' END AS bucket, round((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 3600, 1) AS hours FROM orders GROUP BY 1",
    "optional_filters": "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1",
    "any_tag": f"SELECT status, count(*) AS n FROM {T} WHERE c2 = 'status.p' OR c1 = '1-urgent' GROUP BY 1",
    "profile_changes": f"WITH p AS (SELECT p_partkey % 20 AS profile, {nth('p_partkey', SQL_AXES)} AS axis, p_partkey % 5 + 1 AS a, p_partkey % 4 + 1 AS b, p_partkey % 7 > 0 AS e FROM part WHERE p_partkey < 60), s AS (SELECT *, coalesce(CASE WHEN e THEN a ELSE 0 END / nullif(sum(CASE WHEN e THEN a ELSE 0 END) OVER (PARTITION BY profile), 0), 0) AS x, coalesce(CASE WHEN e THEN b ELSE 0 END / nullif(sum(CASE WHEN e THEN b ELSE 0 END) OVER (PARTITION BY profile), 0), 0) AS y FROM p) SELECT m.profile, m.axis, m.a <> n.b OR m.e <> n.e AS changed, round(m.x, 6) AS influence_before, round(n.y, 6) AS influence_after FROM s m JOIN s n USING (profile, axis)",
    "feature_hints": f"SELECT user_id, round(72 + h % 40 + least(1, artistic / 100) * 46 - least(1, communication / 100) * 18, 4) AS tempo, round(900 + least(1, communication / 100) * 2200 + least(1, artistic / 100) * 1400 + (h // 256) % 400, 4) AS centroid_hz, round(least(1, 0.28 + ({each(lambda a, i: a, ' + ')}) / 6 / 260 + least(0.35, user_id % 5 / 2 * 0.12)), 4) AS energy FROM (SELECT *, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split('u' || user_id, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) AS h FROM {P})",
    "batch_status": "SELECT o_custkey % 90 AS batch_id, count(*) AS rows, count(*) FILTER (o_orderkey % 11 > 0) AS scored, count(*) FILTER (o_orderkey % 11 = 0) AS failed, CASE WHEN count(*) FILTER (o_orderkey % 11 = 0) = 0 THEN 'completed' WHEN count(*) FILTER (o_orderkey % 11 > 0) = 0 THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY 1",
    "sweep_candidates": "SELECT o_orderkey AS source_id FROM orders WHERE o_orderkey > 50 AND o_orderkey % 3 > 0 AND (o_orderkey % 4 = 0 OR o_orderdate < TIMESTAMP '1995-12-31') ORDER BY 1 LIMIT 200",
    "mapping_report": "SELECT 'identifier' AS field, 'primary_identifier' AS column, count(*) AS rows, count(*) AS values FROM customer UNION ALL SELECT 'age band', 'Age', count(*), count(*) FROM customer UNION ALL SELECT 'household', 'Household', count(*), count(*) FROM customer UNION ALL SELECT 'income band', CASE WHEN c_acctbal > 0 THEN 'income_band' END, count(*), count(*) FILTER (c_acctbal > 0) FROM customer GROUP BY 2",
    "folded_words": "SELECT p_partkey, trim('ecole  ' || lower(p_name)) AS words FROM part",
}
