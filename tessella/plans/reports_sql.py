"""SQL of the registered reports, in DuckDB's dialect."""

from __future__ import annotations

from tessella.operators.algebra import LEXICON, SPEECH_LOAD
from tessella.operators.profiles import AXIS_EVENTS

AXES = list(SPEECH_LOAD)
TARGET = dict(zip(AXES, (60.0, 55.0, 50.0, 45.0, 50.0, 50.0)))
WEIGHTS = dict(zip(AXES, (2.0, 1.0, 0.5, 1.0, 1.0, 3.0)))


def each(make, sep: str = ", ") -> str:
    """``make`` of each axis and its number, joined."""
    return sep.join(make(a, i) for i, a in enumerate(AXES))


def nth(column: str, names) -> str:
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[{column} % {len(names)} + 1]"


_AXIS = ", ".join(f"coalesce(least(100.0, avg(value) FILTER (WHERE event_type = '{e}')), 50.0) AS {a}" for a, e in zip(AXES, AXIS_EVENTS)) + f", least(100.0, avg(value)) AS {AXES[-1]}, count(*) AS n"
P = f"(SELECT user_id, {_AXIS} FROM events GROUP BY user_id)"
A = f"(SELECT user_id, day, {', '.join(AXES)}, n, least(1.0, n / 10) AS confidence, day::TIMESTAMP AS created_at, user_id * 100 + day(day) AS analysis_id FROM (SELECT user_id, ts::DATE AS day, {_AXIS} FROM events GROUP BY 1, 2))"
T = f"""(SELECT *, sha256(report_type || '|' || c1 || ',' || c2) AS signature FROM (SELECT o_orderkey AS id, o_custkey AS identifier, 'a' || (o_custkey % 7) AS activation_id, {nth('o_orderkey', ('ctv', 'apps', 'visitation', 'demographics', 'origin'))} AS report_type,
  {nth('o_orderkey', ('done', 'done', 'pending', 'processing', 'failed', 'dead_letter'))} AS status, lower(replace(o_orderpriority, ' ', '')) AS c1, 'status.' || lower(o_orderstatus) AS c2, (o_orderkey % 100) / 100 AS confidence, o_orderdate AS seen_at,
  'Priority: ' || o_orderpriority AS l1, 'Status: ' || o_orderstatus AS l2, 'plain' || (o_orderkey % 3) AS l3 FROM orders))"""
C = f"(SELECT DISTINCT signature, report_type, {each(lambda a, i: f'(length(c1) * {i + 3} % 100)::DOUBLE AS {a}')} FROM {T} WHERE report_type IN ('ctv', 'apps'))"
R = f"""(SELECT t.*, p.user_id IS NOT NULL AS audio, CASE WHEN p.user_id IS NOT NULL THEN 'audio-grounded' WHEN c.signature IS NOT NULL THEN 'text-only' ELSE 'unscored' END AS grounding, {each(lambda a, i: f'CASE WHEN p.user_id IS NOT NULL THEN p.{a} ELSE c.{a} END AS {a}')}
  FROM {T} t LEFT JOIN {P} p ON t.identifier = p.user_id LEFT JOIN {C} c ON t.signature = c.signature AND t.report_type = c.report_type)"""
L = lambda src: f"(SELECT *, CASE WHEN contains(label, ': ') THEN split_part(label, ': ', 1) ELSE report_type END AS family, CASE WHEN contains(label, ': ') THEN split_part(label, ': ', 2) ELSE label END AS value FROM (SELECT *, unnest([l1, l2, l3]) AS label FROM {src}))"
M = "(SELECT c_nationkey % 5 AS cohort_id, 'dev-' || c_custkey AS subject_key, c_custkey % 9 = 0 AS holdout, c_acctbal / 10000 AS similarity, c_custkey AS \"user\" FROM customer)"
REC = f"(SELECT o_orderkey AS record_id, o_custkey % 4 AS dataset_id, {nth('o_orderkey', ('scored', 'scored', 'pending', 'failed'))} AS status, 's' || (o_custkey % 60) AS source_name, (o_orderkey % 100) / 100 AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS kpi, o_orderdate AS seen FROM orders)"
SA = f"(SELECT 's' || (c_custkey % 60) AS source_name, c_custkey AS analysis_id, {nth('c_custkey', ('grounded', 'bridged', 'text-only'))} AS grounding_level FROM customer WHERE c_custkey % 60 < 40)"
CAL = "(SELECT 'k.' || (user_id % 12) AS code, event_type AS category, count(*) AS n, avg(least(100.0, value)) AS mean_score, var_pop(value) * count(*) AS m2 FROM events GROUP BY 1, 2)"
FAIL = f"(SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 11 < 8 THEN ([402, 403, 401, 404, 546, 504, 429, 503])[o_orderkey % 11 + 1] END AS code, o_orderkey % 11 AS k, {nth('o_custkey', ('scored', 'unchanged', 'failed'))} AS outcome, o_custkey % 6 AS attempts FROM orders)"
#: The verdicts of the eleven kinds of failure in the stand-in.
VERDICT = "(SELECT * FROM (VALUES (0, 'credits', false, false, 0), (1, 'policy', false, false, 0), (2, 'auth', false, false, 0), (3, 'schema', false, false, 0), (4, 'resource', true, true, 5000), (5, 'resource', true, true, 4000), (6, 'rate_limit', true, false, 20000), (7, 'transient', true, false, 2000), (8, 'schema', false, false, 0), (9, 'transient', true, false, 2000), (10, 'unknown', true, true, 3000)) AS v(k, kind, retryable, shrink, backoff_ms))"
SLUG = lambda x: f"substr(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"
BOOST = lambda n: f"CASE WHEN {n} > 0 THEN least(1.0, 0.5 + log10(1 + {n}) / 4) ELSE 0.7 END"
HALF_UP = lambda x, k=1: f"floor(({x}) * {k} + 0.5) / {k}"
LEAD = lambda xs: "CASE " + " ".join(f"WHEN {x} = greatest({', '.join(xs)}) THEN '{a}'" for a, x in zip(AXES, xs)) + " END"
DAYPART = "CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 22 THEN 'primetime' ELSE 'latenight' END"
HOST = lambda u: f"regexp_replace(lower(regexp_extract({u}, '(?i)^(?:https?://)?([^/?#\\s]+)', 1)), '^www\\.', '')"
#: Path segments that name no topic.
STOPS = "'www', 'index', 'html', 'htm', 'php', 'amp', 'en', 'en-us', 'us', 'news', 'article', 'articles', 'story', 'stories', 'page', 'pages', 'p', 'id'"
TOPICS = lambda key, url, src: f"""(SELECT k, list(w ORDER BY i)[1:2] AS topics FROM (SELECT k, w, min(i) AS i FROM (SELECT k, i, array_to_string(string_split(regexp_replace(s, '\\.(html?|php|aspx)$', ''), '-')[1:4], '-') AS w FROM
  (SELECT {key} AS k, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT {key}, list_transform(string_split(regexp_replace(regexp_replace({url}, '(?i)^https?://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: lower(trim(x))) AS parts FROM {src}))
  WHERE length(s) >= 3 AND NOT regexp_full_match(s, '[0-9]+') AND s NOT IN ({STOPS})) WHERE length(w) >= 3 GROUP BY k, w) GROUP BY k)"""  # noqa: E731
VISIT = f"(SELECT event_id, user_id::VARCHAR AS identifier, CASE WHEN event_type <> 'error' THEN 'Brand ' || event_type END AS brand, {DAYPART} AS part, CASE WHEN event_id % 4 > 0 THEN value END AS far FROM events)"
VISITED = f"(SELECT *, concat_ws(' · ', brand, part) AS label, CASE WHEN brand IS NULL THEN ['visit.daypart.' || part] ELSE ['visit.brand.brand-' || substr(brand, 7), 'visit.daypart.' || part] END AS codes, CASE WHEN far IS NULL THEN 0.7 WHEN far <= 25 THEN 0.9 WHEN far <= 100 THEN 0.7 WHEN far <= 250 THEN 0.5 ELSE 0.35 END AS confidence FROM {VISIT})"
_FP = lambda days, at: f"""(WITH a AS {A}, m AS (SELECT {each(lambda a, i: f'coalesce(avg({a}), 50) AS m_{a}, coalesce(stddev_samp({a}), 1) AS s_{a}')} FROM a),
  z AS (SELECT user_id, confidence, created_at > TIMESTAMP '{at}' - INTERVAL {days} DAY AS late, {each(lambda a, i: f'CASE WHEN s_{a} < 0.01 THEN 50 ELSE greatest(0, least(100, 100 / (1 + exp(-1.7 * ({a} - m_{a}) / s_{a})))) END AS {a}')} FROM a, m)
  SELECT user_id, {each(lambda a, i: f'round(coalesce(sum({a} * confidence) / nullif(sum(confidence), 0), 50), 2) AS {a}')}, {each(lambda a, i: f'round(coalesce(sum({a} * confidence) FILTER (WHERE late) / nullif(sum(confidence) FILTER (WHERE late), 0), 0), 2) AS {a}_recent')},
  count(*) AS sources, count(*) FILTER (WHERE late) AS recent_sources, round(least(1.0, count(*) / 10) * avg(confidence), 3) AS confidence FROM z GROUP BY user_id)"""  # noqa: E731
_DAMP = lambda src, bias, gains, more="": f"""(WITH d AS (SELECT *, {each(lambda a, i: f'{a} * (1 - {bias} * {SPEECH_LOAD[a]}) AS d_{a}')}, {each(lambda a, i: f'{a} * {bias} * {SPEECH_LOAD[a]}', ' + ')} AS gone FROM {src}),
  w AS (SELECT *, {each(lambda a, i: f'd_{a} * {1 - SPEECH_LOAD[a]}', ' + ')} AS total FROM d),
  g AS (SELECT *, {each(lambda a, i: f'CASE WHEN gone > 0 AND total > 0 THEN gone * d_{a} * {1 - SPEECH_LOAD[a]} / total ELSE 0 END AS g_{a}')} FROM w)
  SELECT * EXCLUDE ({', '.join(AXES)}), {each(lambda a, i: HALF_UP(f'greatest(0, least(100, (d_{a} + g_{a}) * {gains.get(a, 1.0)}))', 10) + f' AS {a}')} FROM g)"""  # noqa: E731
MARKET = f"""(WITH live AS (SELECT event_type AS metric, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1),
  t AS (SELECT user_id AS track, event_type AS metric, avg(value) AS value FROM events GROUP BY 1, 2),
  j AS (SELECT track, t.metric, CASE WHEN n >= 30 AND sd > 0 THEN 'live' ELSE 'published' END AS basis, CASE WHEN n >= 30 AND sd > 0 THEN (value - mean) / sd ELSE (value - 40) / 20 END AS z, CASE t.metric WHEN 'error' THEN 0.3 WHEN 'click' THEN 0.25 WHEN 'purchase' THEN 0.2 WHEN 'view' THEN 0.15 ELSE 0.1 END AS w FROM t LEFT JOIN live USING (metric)),
  e AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS q FROM j),
  f AS (SELECT *, 1 - ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-x * x) AS erf FROM e)
  SELECT *, CASE WHEN z >= 0 THEN 0.5 * (1 + erf) ELSE 0.5 * (1 - erf) END AS cdf, least(abs(z), 2.0) * 50 AS d FROM f)"""

ORACLE_SQL: dict[str, str] = {
    "delivery_routes": f"SELECT o_orderkey, {nth('o_orderkey', ('demographics', 'apps', 'visitation', '-', 'ctv', '-', 'origin', '-', '-')).join(('nullif(', chr(44) + chr(39) + '-' + chr(39) + ')'))} AS report_type, o_orderkey % 9 = 5 AS audio, o_orderkey % 9 = 8 AS manifest FROM orders WHERE o_orderkey < 400",
    "web_tags": f"""WITH p AS (SELECT page_id, url, {HOST('url')} AS domain, page_id % 30 AS n FROM pages), t AS {TOPICS('page_id', 'url', 'p')}
      SELECT 'p' || (page_id % 40) AS identifier, concat_ws(' · ', domain, topics[1]) AS label, array_to_string(list_concat(['ctv.channel.' || {SLUG('domain')}, 'iab.iab' || (page_id % 9), 'iab.iab-7'], coalesce(list_transform(topics, lambda x: 'web.topic.' || {SLUG('x')}), []), ['web.referrer.ref' || (page_id % 3) || '-org-80']), ',') AS codes,
      round({BOOST('n')}, 3) AS confidence FROM p LEFT JOIN t ON page_id = k""",
    "visit_tags": f"SELECT identifier, label, array_to_string(codes, ',') AS codes, confidence FROM {VISITED}",
    "app_tags": f"SELECT p_partkey::VARCHAR AS identifier, p_type || ' · ' || p_brand AS label, 'app.category.' || {SLUG('p_type')} || ',app.taxonomy.' || {SLUG('p_brand')} AS codes, round_even({BOOST('(p_size - 5)')}, 3) AS confidence FROM part WHERE p_partkey % 5 > 0",
    "people_tags": "SELECT c_custkey::VARCHAR AS identifier, concat_ws(' · ', (c_nationkey * 3) || '-99', i) AS label, concat_ws(',', 'demo.age.' || (c_nationkey * 3) || '-99', 'demo.income.' || i, 'demo.household.' || lower(c_mktsegment)) AS codes, 0.7 AS confidence FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 1000)::INT::VARCHAR END AS i FROM customer)",
    "origin_tags": f"SELECT s_suppkey::VARCHAR AS identifier, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' · Urban Core' AS label, concat_ws(',', 'origin.class.urban-core', 'origin.region.' || {SLUG('n_name')}, CASE WHEN s_acctbal > 5000 THEN 'origin.travel.long-haul' END) AS codes, 0.7 AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "merged_visits": f"WITH v AS {VISITED}, c AS (SELECT identifier, list_sort(list(DISTINCT c)) AS codes FROM (SELECT identifier, unnest(codes) AS c FROM v) GROUP BY 1) SELECT identifier, arg_min(label, event_id) AS label, len(any_value(c.codes)) AS n_tags, array_to_string(any_value(c.codes), ',') AS codes, least(200, count(*)) AS n_signals, max(confidence) AS confidence FROM v JOIN c USING (identifier) GROUP BY identifier",
    "summary_tags": f"SELECT 'activation:' || (p_partkey % 4) AS identifier, p_brand || ' · ' || p_type AS label, 'app.category.' || {SLUG('p_type')} || ',app.taxonomy.' || {SLUG('p_brand')} AS codes, round(s, 4) AS share, round(least(1.0, 0.5 + 0.5 * s), 4) AS confidence FROM (SELECT *, p_size / sum(p_size) OVER (PARTITION BY p_partkey % 4) AS s FROM part)",
    "delivery_quality": "SELECT sum(n)::BIGINT AS rows, count(*) AS keys, min(n) AS least, median(n) AS median, round(avg(n), 4) AS mean, max(n) AS most, abs(median(n) - 10) / 10 > 0.25 AS drifted FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    "csv_contract": "SELECT o_custkey::VARCHAR AS external_user_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS source_name, CASE WHEN o_orderkey % 4 > 0 THEN least(100.0, o_orderkey % 130) END AS emotional, 1000.0 + o_orderkey % 900 + 100 AS kpi_ctr, o_orderstatus AS market, o_orderkey % 4 > 0 AS complete FROM orders",
    "signal_coverage": f"SELECT CASE WHEN id % 11 > 0 THEN activation_id ELSE 'unassigned' END AS activation_id, count(*) AS identifiers, count(*) FILTER (status <> 'pending') AS tagged, count(*) FILTER (status = 'done') AS scored FROM {T} GROUP BY 1",
    "cohort_list": f"SELECT i AS cohort_id, 'c' || i AS slug, coalesce(m, 0) AS members, coalesce(h, 0) AS holdout, s AS avg_similarity, x AS last_export_at FROM range(7) r(i) LEFT JOIN (SELECT cohort_id, count(*) AS m, count(*) FILTER (holdout) AS h, round(avg(similarity), 4) AS s FROM {M} GROUP BY 1) ON cohort_id = i LEFT JOIN (SELECT o_custkey % 5 AS c, max(o_orderdate) AS x FROM orders GROUP BY 1) ON c = i",
    "segment_lift": f"""WITH e AS (SELECT event_type AS metric, value, user_id, user_id IN (SELECT user_id FROM {P} WHERE emotional > 50) AS s FROM events),
      g AS (SELECT metric, count(*) FILTER (s) AS segment_events, count(DISTINCT user_id) FILTER (s) AS segment_devices, round(avg(value) FILTER (s), 3) AS segment_avg, count(*) FILTER (NOT s) AS other_events, count(DISTINCT user_id) FILTER (NOT s) AS other_devices, round(avg(value) FILTER (NOT s), 3) AS other_avg FROM e GROUP BY 1)
      SELECT *, CASE WHEN other_avg <> 0 THEN round((segment_avg - other_avg) / abs(other_avg) * 100, 1) END AS lift_pct FROM g""",
    "segment_axes": f"UNPIVOT (SELECT {each(lambda a, i: f'round(avg({a}), 1) AS {a}')} FROM {R}) ON {', '.join(AXES)} INTO NAME axis VALUE score",
    "enrichment_status": f"SELECT activation_id, count(*) AS rows_total, count(*) FILTER (status = 'done') AS rows_scored, count(*) FILTER (status IN ('pending', 'processing')) AS rows_waiting, count(*) FILTER (status IN ('failed', 'dead_letter')) AS rows_failed, round(avg(confidence), 3) AS avg_confidence, round(count(*) FILTER (status = 'done') / count(*) * 100, 1) AS coverage_pct FROM {T} GROUP BY 1",
    "enrichment_labels": f"SELECT * FROM (SELECT activation_id, label, count(*) AS rows, row_number() OVER (PARTITION BY activation_id ORDER BY count(*) DESC, label) AS rank FROM {L(T)} GROUP BY 1, 2) WHERE rank <= 4",
    "signal_families": f"SELECT family, count(DISTINCT value) AS n_values, count(DISTINCT id) AS devices FROM {L(T)} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
    "signal_axes": f"SELECT family, value, devices, audio_devices, avg_confidence, {each(lambda a, i: f'round({a}, 1) AS {a}')}, {LEAD(AXES)} AS lead, round(greatest({', '.join(AXES)}), 1) AS lead_score FROM (SELECT family, value, count(DISTINCT id) AS devices, count(DISTINCT id) FILTER (audio) AS audio_devices, round(avg(confidence), 3) AS avg_confidence, {each(lambda a, i: f'avg({a}) AS {a}')} FROM {L(R)} WHERE grounding <> 'unscored' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 12)",
    "signal_devices": f"WITH p AS {L(T)} SELECT identifier AS id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM p WHERE identifier IN (SELECT identifier FROM p WHERE family = 'Status' AND value = 'P') GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10 OFFSET 5",
    "own_data": f"SELECT dataset_id::VARCHAR AS dataset_id, count(*) AS rows, count(*) FILTER (status = 'scored') AS scored, round(avg(confidence) FILTER (status = 'scored'), 3) AS avg_confidence, count(kpi) AS with_kpi, max(seen) AS last_at FROM {REC} GROUP BY ROLLUP (dataset_id)",
    "feed_status": f"""WITH r AS {REC}, l AS (SELECT source_name, arg_max(grounding_level, analysis_id) AS level FROM {SA} GROUP BY 1),
      g AS (SELECT dataset_id, count(*) AS raw, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, max(seen) FILTER (status = 'scored') AS last_scored_at, round((epoch(TIMESTAMP '1999-01-01') - epoch(min(seen) FILTER (status = 'pending'))) / 3600, 1) AS pending_age_hours FROM r GROUP BY 1),
      s AS (SELECT dataset_id, count(*) AS sampled, count(level) AS e, count(*) FILTER (level IN ('grounded', 'bridged')) AS t FROM r LEFT JOIN l USING (source_name) WHERE status = 'scored' GROUP BY 1)
      SELECT dataset_id, raw, scored, pending, failed, last_scored_at, pending_age_hours, sampled, round(e / sampled * 100, 1) AS enriched_pct, round(t / sampled * 100, 1) AS tagged_pct, round(scored * (e / sampled)) AS enriched_est, round(scored * (t / sampled)) AS tagged_est FROM g JOIN s USING (dataset_id)""",
    "identifier_grounding": f"SELECT grounding, count(*) AS rows, round(avg(confidence), 4) AS confidence FROM {R} GROUP BY 1",
    "grounding_levels": f"SELECT grounding_level AS level, count(*) AS profiles, sum(analysis_id)::BIGINT AS identifiers, count(*) FILTER (analysis_id % 2 = 0) AS with_audio FROM {SA} GROUP BY 1",
    "population": f"SELECT axis, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS sd, " + " || ',' || ".join(f"count(*) FILTER (least(9, floor(score / 10)) = {i})" for i in range(10)) + f" AS bins FROM (UNPIVOT {P} ON {', '.join(AXES)} INTO NAME axis VALUE score) GROUP BY 1",
    "activation_tags": f"WITH t AS {T}, h AS (SELECT activation_id, code, count(*) AS hits FROM (SELECT activation_id, unnest([c1, c2]) AS code FROM t) WHERE code <> 'status.p' GROUP BY 1, 2) SELECT * FROM (SELECT activation_id, code, round(hits / n, 4) AS weight, row_number() OVER (PARTITION BY activation_id ORDER BY hits DESC, code) AS rank FROM h JOIN (SELECT activation_id, count(*) AS n FROM t GROUP BY 1) USING (activation_id)) WHERE rank <= 3",
    "activation_axes": f"SELECT activation_id, count(*) AS scored, 0.8 AS confidence, {LEAD([f'avg({a})' for a in AXES])} AS lead, {each(lambda a, i: f'round(avg({a}))::INT AS {a}')} FROM {T} JOIN {P} ON identifier = user_id GROUP BY 1",
    "dataset_state": f"SELECT activation_id, count(*) AS row_count, count(*) FILTER (status = 'done') AS scored_count, CASE WHEN count(*) FILTER (status = 'done') >= count(*) THEN 'ready' ELSE 'scoring' END AS status FROM {T} WHERE status = 'done' OR activation_id <> 'a3' GROUP BY 1",
    "cost_estimate": f"""WITH t AS {T}, c AS {C}, a AS (SELECT activation_id, count(*) AS total_rows, count(*) FILTER (status = 'done') AS done_rows, count(*) FILTER (status = 'pending') AS pending_rows FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
      s AS (SELECT activation_id, count(*) AS n, count(*) FILTER (signature IN (SELECT signature FROM c)) AS k, count(DISTINCT signature) AS d, count(DISTINCT signature) FILTER (signature NOT IN (SELECT signature FROM c)) AS b FROM t WHERE status = 'pending' GROUP BY 1)
      SELECT activation_id, total_rows, done_rows, pending_rows, coalesce(n, 0) AS sampled_rows, coalesce(k, 0) AS sampled_cached_rows, coalesce(d, 0) AS distinct_signatures, coalesce(b, 0) AS billable_signatures FROM a LEFT JOIN s USING (activation_id)""",
    "listener_refresh": f"WITH i AS (SELECT identifier % 150 AS source_id, id % 3 AS o, seen_at FROM {T}), a AS {A}, l AS (SELECT user_id, arg_max(emotional, analysis_id) AS emotional, arg_max(confidence, analysis_id) AS confidence FROM a GROUP BY 1) SELECT source_id, count(*) AS identifier_count, greatest(sum(o), 1)::BIGINT AS observation_count, max(seen_at) AS last_seen, round(any_value(emotional), 4) AS emotional, any_value(confidence) AS confidence, source_id < 100 AS has_audio FROM i JOIN l ON source_id = user_id GROUP BY source_id",
    "queue_depth": f"SELECT least(150, count(*) FILTER (status IN ('pending', 'processing'))) AS waiting, least(150, count(*) FILTER (status = 'dead_letter')) AS dead FROM {T}",
    "custody_scan": "SELECT d AS device_identifiers, i AS ip_identifiers, 0 AS device_members, 0 AS ip_members, d + i AS violations_total, d + i = 0 AS clean FROM (SELECT count(*) FILTER (c_custkey % 50 = 0) AS d, count(*) FILTER (c_custkey % 50 > 0 AND (c_custkey % 70 = 0 OR c_custkey % 90 = 0)) AS i FROM customer)",
    "floor_percentiles": "SELECT event_type, s[floor(0.5 * (n - 1))::INT + 1] AS p50, s[floor(0.95 * (n - 1))::INT + 1] AS p95, s[n] AS top, n AS samples FROM (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY 1)",
    "user_fingerprints": f"SELECT * FROM {_FP(10, '2024-01-31')}",
    "fingerprint_drift": f"""SELECT user_id, CASE WHEN none THEN 0 ELSE round(least(100, far / sqrt(60000) * 100), 2) END AS distance_pct, CASE WHEN NOT none THEN axis END AS axis, CASE WHEN none THEN 'flat' WHEN moved > 2 THEN 'up' WHEN moved < -2 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT user_id, greatest({each(lambda a, i: f'{a}_recent')}) = 0 AS none,
      sqrt({each(lambda a, i: f'({a}_recent - {a}) ** 2', ' + ')}) AS far, {LEAD([f'abs({a}_recent - {a})' for a in AXES])} AS axis, CASE {each(lambda a, i: f"WHEN abs({a}_recent - {a}) = greatest({each(lambda b, j: f'abs({b}_recent - {b})')}) THEN {a}_recent - {a}", ' ')} END AS moved FROM {_FP(5, '2024-01-31')})""",
    "speech_damping": f"SELECT user_id, {', '.join(AXES)}, round(d_communication, 4) AS communication_damped, round(g_social, 4) AS social_given FROM {_DAMP(f'(SELECT user_id, {chr(44).join(AXES)} FROM {P})', 0.5, {'artistic': 1.2})}",
    "auto_tune": f"""WITH m AS (SELECT count(*) AS n, {each(lambda a, i: f'avg({a}{" + 30" if a == "communication" else ""}) AS {a}')} FROM {P}),
      b AS (SELECT *, CASE WHEN communication > o THEN greatest(0, least(1, floor((communication - o) / communication / 0.6 * 20 + 0.5) / 20)) ELSE 0 END AS bias FROM (SELECT *, ({' + '.join(a for a in AXES if a != 'communication')}) / 5 AS o FROM m)),
      l AS (SELECT * FROM {_DAMP('(SELECT * FROM b)', 'bias', {})}), k AS (SELECT b.*, {each(lambda a, i: f'l.{a} AS l_{a}')}, ({each(lambda a, i: f'l.{a}', ' + ')}) / 6 AS lm FROM b, l)
      SELECT n, {each(lambda a, i: f'round({a}, 4) AS {a}')}, bias, {each(lambda a, i: f'round(CASE WHEN l_{a} <= 0 THEN 1 ELSE greatest(0.5, least(1.5, floor((1 + 0.5 * (lm / l_{a} - 1)) * 20 + 0.5) / 20)) END, 2) AS gain_{a}')} FROM k""",
    "brief_axes": f"SELECT user_id, {each(lambda a, i: f'floor(greatest(20, least(90, 55 + 16 * CASE WHEN sd > 1e-6 THEN ({a} / 100 - m) / sd ELSE 0 END)) + 0.5) AS {a}')} FROM (SELECT *, list_avg(v) AS m, list_stddev_samp(v) AS sd FROM (SELECT *, [{each(lambda a, i: f'{a} / 100')}] AS v FROM {P}))",
    "feedback_bias": "WITH t AS (SELECT DISTINCT p_partkey % 50 AS s, p_partkey % 20 AS node_id FROM part), c AS (SELECT s, count(*) AS n FROM t GROUP BY 1), f AS (SELECT o_custkey % 50 AS s, lower(o_orderstatus) AS category, (o_orderkey % 70 - o_orderkey % 90) * 0.25 AS d FROM orders WHERE o_orderkey % 5 = 0) SELECT node_id, category, round(sum(d / n), 6) AS bias FROM f JOIN c USING (s) JOIN t USING (s) WHERE d <> 0 GROUP BY 1, 2",
    "tag_attribution": f"""WITH t AS (SELECT event_type AS subject, 'k.' || (user_id % 12) AS code, count(*) / 100 AS weight FROM events GROUP BY 1, 2), e AS (SELECT *, weight * mean_score / 100 * (n / (n + 3)) AS evidence FROM t JOIN {CAL} USING (code))
      SELECT * FROM (SELECT subject, category, code, round(evidence / sum(evidence) OVER w, 4) AS share, floor(sum(weight * mean_score) OVER w / sum(weight) OVER w + 0.5) AS tag_score, row_number() OVER (PARTITION BY subject, category ORDER BY evidence DESC, code) AS rank FROM e WHERE evidence > 0 WINDOW w AS (PARTITION BY subject, category)) WHERE rank <= 6""",
    "prior_pool": f"SELECT category, floor(sum(mean_score * n) / sum(n) + 0.5) AS mean, floor(sqrt(sum(CASE WHEN n > 1 THEN m2 / (n - 1) ELSE 0 END) / (SELECT count(DISTINCT category) FROM {CAL})) + 0.5) AS sd, sum(n)::BIGINT AS n FROM {CAL} GROUP BY 1",
    "axis_agreement": f"SELECT user_id, round((user_id % 20)::DOUBLE, 4) AS max_delta, user_id % 20 <= 12 AS agrees FROM {P}",
    "regression_drift": " UNION ALL ".join(f"SELECT '{a}' AS axis, count(*) AS n, round(avg(user_id % {3 * i + 2}), 4) AS mean_abs, max(user_id % {3 * i + 2})::DOUBLE AS max_abs, max(user_id % {3 * i + 2}) <= 8 AS within FROM {P}" for i, a in enumerate(AXES)),
    "resonance": f"SELECT user_id, {HALF_UP(f'greatest(0, least(100, 100 * (1 - sqrt(s) / sqrt({sum(WEIGHTS.values()) * 10_000}))))', 10)} AS score, {HALF_UP('sqrt(s)', 10)} AS distance, weakest FROM (SELECT user_id, {each(lambda a, i: f'{WEIGHTS[a]} * ({a} - {TARGET[a]}) ** 2', ' + ')} AS s, {LEAD([f'{WEIGHTS[a]} * ({a} - {TARGET[a]}) * ({a} - {TARGET[a]})' for a in AXES])} AS weakest FROM {P})",
    "profile_similarity": "SELECT user_id, round(greatest(0, 100 - (" + " + ".join(f"{w} * abs(greatest(0, least(100, {TARGET[a]} + {b})) - greatest(0, least(100, {a} + {b})))" for a, w, b in zip(AXES[:5], (1, 2, 1, 3, 1), (0, 5, -5, 10, 0))) + f") / 8), 4) AS similarity FROM {P}",
    "market_metrics": f"SELECT track, metric, floor(z * 100 + 0.5) / 100 AS z, floor(greatest(0, least(100, cdf * 100)) + 0.5) AS percentile, floor(d + 0.5) AS distinctiveness, basis FROM {MARKET}",
    "market_scores": f"SELECT track, floor(sum(d * w) / sum(w) + 0.5) AS score, floor(round(greatest(0, least(1, 0.75 * sum(w) + 0.25 * sum(w) FILTER (basis = 'live') / sum(w))), 9) * 1000 + 0.5) / 1000 AS confidence FROM {MARKET} GROUP BY 1",
    "meta_fingerprint": f"""WITH c AS (SELECT user_id % 6 AS k, count(*) AS members, {each(lambda a, i: f'avg({a}) AS {a}')}, (user_id % 6 + 1) / 10 AS confidence FROM {P} GROUP BY user_id % 6), t AS (SELECT sum(members)::BIGINT AS members, count(*) AS cohorts, {each(lambda a, i: f'sum({a} * members) / sum(members) AS {a}')} FROM c),
      f AS (SELECT sum(sqrt({each(lambda a, i: f'(c.{a} - t.{a}) ** 2', ' + ')}) * c.members) / sum(c.members) / sqrt(60000) * 100 AS s, sum(confidence * c.members) / sum(c.members) AS q FROM c, t)
      SELECT {each(lambda a, i: f'round({a}, 4) AS {a}')}, members, cohorts, round(s, 1) AS dispersion_pct, round(q * (1 - s / 100), 3) AS confidence FROM t, f""",
    "text_fingerprint": "WITH p AS (SELECT p_brand, lower(p_name || ' ' || p_type) AS x, CASE WHEN p_size > 0 THEN p_size ELSE 1 END AS w FROM part), h AS (SELECT p_brand, w, " + each(lambda a, i: "least(2, " + " + ".join(f"contains(x, '{k}')::INT" for k in LEXICON[a]) + f") * w AS {a}")
    + f" FROM p), g AS (SELECT p_brand, {each(lambda a, i: f'sum({a}) AS {a}')}, sum(w) AS all_, coalesce(sum(w) FILTER (greatest({', '.join(AXES)}) > 0), 0) AS hit FROM h GROUP BY 1) SELECT p_brand, {each(lambda a, i: f'floor(least(100, 42 + {a} / greatest(1, {chr(44).join(AXES)}) * 46) + 0.5) AS {a}')}, floor(hit / all_ * 100 + 0.5) / 100 AS coverage FROM g",
    "grounding_claims": "SELECT CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 THEN 'grounded' WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 2 THEN 'bridged' ELSE 'text-only' END AS level, count(*) AS n FROM orders GROUP BY 1",
    "activation_file": f"SELECT upper(substr(sha256(subject_key), 1, 32)) AS eid, subject_key FROM {M} WHERE NOT holdout",
    "activation_counts": f"SELECT count(*) FILTER (holdout) AS held_out, count(*) FILTER (NOT holdout AND \"user\" % 10 = 0) AS skipped, count(*) FILTER (NOT holdout AND \"user\" % 10 > 0) AS eids FROM {M}",
    "export_refusals": f"SELECT 'c' || cohort_id AS slug, count(*) * 4 >= 1000 AND cohort_id <> 2 AS allowed FROM {M} GROUP BY cohort_id",
    "exported_activations": f"SELECT DISTINCT cohort_id, 'a' || (o_custkey % 7) AS activation_id FROM {M} JOIN orders ON o_custkey = \"user\" WHERE NOT holdout",
    "enqueue_merge": f"SELECT id::VARCHAR AS id, CASE WHEN id % 3 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 4 = 0 THEN 'new' END WHEN status = 'pending' AND id % 4 = 0 THEN 'new' ELSE report_type END AS label, CASE WHEN id % 3 = 0 OR (status = 'pending' AND id % 2 = 0) THEN confidence + 1 ELSE confidence END AS confidence FROM {T} WHERE id % 3 <> 0 OR id % 2 = 0",
    "finish_jobs": f"SELECT id, CASE WHEN id % 6 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN confidence / 2 ELSE confidence END AS confidence FROM {T}",
    "stage_rollups": "SELECT 'f' AS object_key, 'u' || (user_id % 20) AS subject, event_type AS code, CASE WHEN event_id % 5 > 0 THEN ts::DATE END AS day, sum(CASE WHEN event_id % 7 > 0 THEN event_id % 4 ELSE 1 END)::DOUBLE AS weight FROM events GROUP BY 2, 3, 4",
    "daily_runs": "SELECT user_id, ts::DATE AS day, count(*) AS runs, count(*) < 20 AS allowed FROM events GROUP BY 1, 2",
    "failure_classes": f"SELECT kind, retryable, shrink, backoff_ms, count(*) AS n FROM {FAIL} JOIN {VERDICT} USING (k) GROUP BY ALL",
    "task_outcomes": f"""SELECT job_id, status, attempts, step_scale, CASE WHEN status = 'pending' THEN round(greatest(backoff_ms, 500) * 2 ** greatest(0, old - 1))::BIGINT END AS wait_ms FROM (SELECT job_id, backoff_ms, attempts AS old, CASE WHEN outcome = 'scored' THEN 'done' WHEN outcome = 'unchanged' THEN 'skipped' WHEN kind NOT IN ('credits', 'policy') AND (NOT retryable OR attempts >= 4) THEN 'dead_letter' ELSE 'pending' END AS status,
      CASE WHEN outcome = 'failed' AND kind IN ('credits', 'policy') THEN greatest(0, attempts - 1) ELSE attempts END AS attempts, CASE WHEN outcome = 'failed' AND shrink THEN 0.5 ELSE 1.0 END AS step_scale FROM {FAIL} JOIN {VERDICT} USING (k))""",
    "reaped_claims": "SELECT o_orderkey, CASE WHEN s THEN 'discovered' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'done' END AS status, CASE WHEN NOT s AND o_orderkey % 2 = 0 THEN o_orderdate END AS started_at FROM (SELECT *, o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 30 MINUTE AS s FROM orders)",
    "queue_positions": f"SELECT id AS job_id, row_number() OVER (ORDER BY id % 5 DESC, seen_at, id) AS position FROM {T} WHERE status = 'pending' QUALIFY position <= 100",
    "purge_cascade": "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00') GROUP BY 1",
    "weighted_fit": f"SELECT user_id, round(least(1, greatest(0, f) + CASE WHEN user_id % 7 = 0 THEN 0.15 ELSE 0 END), 6) AS fit, {LEAD(AXES)} AS lead FROM (SELECT *, least(1, 1 - ({each(lambda a, i: f'{WEIGHTS[a]} * abs({a} - {TARGET[a]})', ' + ')}) / {100 * sum(WEIGHTS.values())}) AS f FROM {P}) ORDER BY fit DESC, user_id LIMIT 20",
    "grounding_rescore": f"""WITH s AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, {each(lambda a, i: f'(vec_id * {i + 3} % 101)::DOUBLE AS {a}')} FROM embeddings),
      n AS (SELECT q.id AS q, b.*, round(list_cosine_similarity(q.v, b.v), 6) AS sim FROM s q, s b WHERE q.label >= 5 AND q.id % 10 = 0 AND b.label < 5 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, b.v), 6) DESC, b.id) <= 8),
      g AS (SELECT q AS id, count(*) AS n, avg(sim) AS sim, {each(lambda a, i: f'sum({a} * sim) / sum(sim) AS {a}')}, ({each(lambda a, i: f'stddev_pop({a})', ' + ')}) / 6 AS spread FROM n WHERE sim >= 0.15 GROUP BY 1),
      w AS (SELECT *, least(1, greatest(0, 1 - spread / 40)) AS agr FROM g), x AS (SELECT *, least(0.35, greatest(0, 0.35 * sim * agr * least(1, n / 3))) AS wt FROM w)
      SELECT s.id, {each(lambda a, i: f'round((1 - wt) * s.{a} + wt * x.{a})::INT AS {a}')}, least(0.9, round(0.5 + 0.25 * wt * agr, 3)) AS confidence FROM s JOIN x USING (id) WHERE wt > 0.01""",
    "prior_targets": f"WITH p AS (SELECT CASE category {' '.join(f'WHEN {chr(39)}{e}{chr(39)} THEN {chr(39)}{a}{chr(39)}' for e, a in zip(AXIS_EVENTS, AXES))} END AS axis, sum(mean_score * w) / sum(w) AS prior FROM (SELECT *, split_part(code, '.', 2)::INT / 12 * least(n, 25) AS w FROM {CAL}) WHERE split_part(code, '.', 2)::INT / 12 > 0.05 GROUP BY 1), d AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {TARGET[a]})' for a in AXES)}) AS v(axis, described)) SELECT axis, floor(greatest(20, least(90, coalesce(0.5 * described + 0.5 * prior, described))) + 0.5) AS target FROM d LEFT JOIN p USING (axis)",
    "bridged_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 25 = 0), w AS (SELECT vec_id, list_concat(e, e[1:32]) AS p, list_transform(range(1, 17), lambda i: e[i] + e[i + 16] + e[i + 32] + e[i + 48]) AS f FROM v), n AS (SELECT *, sqrt(list_sum(list_transform(p, lambda x: x * x))) AS pn, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS fn FROM w)
      SELECT vec_id, round(p[1] / pn, 4) AS p0, round(p[64] / pn, 4) AS p63, round(p[65] / pn, 4) AS p64, round(p[96] / pn, 4) AS p95, round(f[1] / fn, 4) AS f0, round(f[16] / fn, 4) AS f15 FROM n""",
    "weighted_vectors": """WITH v AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 'audio' ELSE 'text' END AS space, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 > 0 THEN vec_id % 4 ELSE 1 END AS w FROM embeddings), b AS (SELECT label, arg_max(space, (t, space)) AS space FROM (SELECT label, space, sum(w) AS t FROM v GROUP BY 1, 2) GROUP BY 1),
      x AS (SELECT label, space, w, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos, count(*) OVER (PARTITION BY label) AS c FROM v JOIN b USING (label, space)), m AS (SELECT label, space, pos, sum(w * x) / sum(w) AS x, count(*) AS used FROM x GROUP BY 1, 2, 3)
      SELECT * FROM (SELECT label, space, used, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS value FROM m) WHERE pos < 3""",
    "seed_profile": f"SELECT count(*) AS n, {each(lambda a, i: f'floor(least(100, avg({a})) + 0.5) AS {a}')} FROM {P} WHERE user_id < 40 HAVING count(*) >= 3",
    "match_prefix": "SELECT vec_id, round(s, 4) AS similarity FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_concat([1.0], list_transform(range(63), lambda i: 0.5))::DOUBLE[]), 6) AS s FROM embeddings WHERE label < 4 AND vec_id <> 7 ORDER BY s DESC, vec_id LIMIT 12)",
    "slice_lift": f"SELECT CASE WHEN holdout THEN 'holdout' ELSE 'exposed' END AS arm, count(*) AS n, round(avg(v), 2) AS mean FROM {M} JOIN (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = \"user\" GROUP BY 1",
}
