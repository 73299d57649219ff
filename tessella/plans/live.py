"""Registered queries on the vector index, live streams and staged scoring, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.storage import shared_path
from tessella.operators import audio, score_run, scoring, vector_index
from tessella.plans.catalogues import beacon_rows, site_tags
from tessella.plans.reports import AXES, load, tasks
from tessella.plans.reports_sql import T, each
from tessella.streaming import ingest, live

#: A window of the stream of live scores: the events of a user lie hours apart.
WINDOW = 43_200


def _indexed(s: SparkSession, d: str) -> DataFrame:
    base = load(s, d, "embeddings")
    found = vector_index.search_index(vector_index.build_index(base), base.where("vec_id % 50 = 0"), exact=True)
    return found.select("query_id", "rank", F.round("similarity", 4).alias("similarity"))


def _said(calls: DataFrame) -> DataFrame:
    """What a window's features say, of the event's value and number."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    axes = {a: (F.floor("value") * (i + 3) % 90).cast("double") for i, a in enumerate(AXES)}
    rows = calls.withColumns({"rms": F.least(F.lit(1.0), F.col("value") / 200), "centroid_hz": k * 50, "chroma": F.array().cast("array<double>"), **axes})
    return rows.withColumn("said", audio.described(rows)).drop("rms", "centroid_hz", "chroma", *AXES)


def _live(s: SparkSession, d: str) -> DataFrame:
    stream = ingest.event_stream(s, d).select("user_id", "event_id", "ts", "value", "props")
    return live.live_scores(stream, "user_id", "event_id", WINDOW, _said).select("event_id", "user_id", "throttled", "retry_in_ms", "turned_down", "said")


def _streamed_beacons(s: SparkSession, d: str) -> DataFrame:
    good, bad = live.stream_beacons(beacon_rows(ingest.table_stream(s, d, "pages.parquet")), lambda: site_tags(s), ("ctr", "reach"))
    columns = ["page_id", "problem", "number", "utm_source"]
    return good.withColumn("problem", F.lit(None).cast("string")).select(columns).unionByName(bad.select(columns))


def _staged(s: SparkSession, d: str) -> score_run.ScoreStore:
    """Orders as tasks of their customers: even ones in a first run, odd ones in a second; then
    the first once more, which changes nothing."""
    rows = tasks(s, d).select(F.col("id").alias("task_id"), "identifier", "report_type", "codes", "confidence", (F.col("id") % 3).cast("int").alias("signals"), F.get("labels", F.lit(0)).alias("label"), F.col("seen_at").cast("timestamp").alias("seen_at"))
    nodes = s.createDataFrame([("5-low", "Low", True), ("1-urgent", "Urgent", False)], "code string, label string, suppressed boolean")
    store = score_run.ScoreStore(s, shared_path(s, "scores"))
    for run, own in (("even", rows.where("task_id % 2 = 0")), ("odd", rows.where("task_id % 2 = 1")), ("even", rows)):
        score_run.run_scores(store, run, own, nodes, scoring.stub_scorer)
    return store


def _staged_outcomes(s: SparkSession, d: str) -> DataFrame:
    out = _staged(s, d).read("outcomes").groupBy((F.col("task_id") % 2).alias("odd"), "status", "from_cache")
    return out.agg(F.count("*").alias("n"), F.sum("suppressed").alias("suppressed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "indexed_neighbours": _indexed,
    "live_scores": _live,
    "streamed_beacons": _streamed_beacons,
    "staged_identifiers": lambda s, d: _staged(s, d).read("identifiers").select("identifier", F.array_join(F.array_sort("codes"), ",").alias("codes"), "observations", *AXES),
    "staged_outcomes": _staged_outcomes,
}

#: What becomes of each task, and the scores of its signature.
_STAGED = f"""r AS (SELECT *, id % 2 AS odd, row_number() OVER (PARTITION BY id % 2, identifier ORDER BY id) = 1 AS lead FROM {T}),
  l AS (SELECT a.*, b.identifier IS NOT NULL AND a.c1 IN (b.c1, b.c2) AND a.c2 IN (b.c1, b.c2) AS known FROM r a LEFT JOIN r b ON a.identifier = b.identifier AND a.odd = 1 AND b.odd = 0 AND b.lead),
  o AS (SELECT *, CASE WHEN NOT lead THEN 'deferred' WHEN known THEN 'unchanged' ELSE 'scored' END AS state FROM l),
  w AS (SELECT *, row_number() OVER (PARTITION BY state, signature ORDER BY odd, id) > 1 AS hit, {each(lambda a, i: f"floor(('0x' || substr(signature, {2 * i + 1}, 2))::INT / 255 * 100 + 0.5) AS {a}")} FROM o)"""
_GAP = WINDOW * 800_000
ORACLE_SQL: dict[str, str] = {
    "live_scores": f"""WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL),
      g AS (SELECT user_id, event_id, r, us AS last, FALSE AS throttled, NULL::BIGINT AS wait, 0 AS turned, 0 AS missed FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.us - g.last < {_GAP} THEN g.last ELSE e.us END, e.us - g.last < {_GAP}, CASE WHEN e.us - g.last < {_GAP} THEN ({_GAP} - (e.us - g.last)) // 1000 END,
          CASE WHEN e.us - g.last < {_GAP} THEN g.turned + 1 ELSE 0 END, g.turned FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1),
      a AS (SELECT event_id, value, coalesce(json_extract(props, '$.k')::DOUBLE, 0) * 50 AS hz, {each(lambda a, i: f'floor(value)::BIGINT * {i + 3} % 90 AS {a}')} FROM events),
      t AS (SELECT event_id, array_to_string(list(axis ORDER BY v DESC, k)[1:2], ' and ') AS top FROM (SELECT event_id, unnest(['{"', '".join(AXES)}']) AS axis, unnest([{', '.join(AXES)}]) AS v, unnest(range(6)) AS k FROM a) GROUP BY 1)
      SELECT event_id, user_id, throttled, wait AS retry_in_ms, CASE WHEN NOT throttled THEN missed END AS turned_down, CASE WHEN NOT throttled THEN 'A ' || CASE WHEN value / 200 > 0.55 THEN 'loud' WHEN value / 200 > 0.22 THEN 'moderate' ELSE 'quiet' END || ', ' || CASE WHEN hz > 3200 THEN 'very bright, sibilant' WHEN hz > 1800 THEN 'bright' WHEN hz > 900 THEN 'warm' ELSE 'dark, bass-heavy' END
        || ' ' || CASE WHEN communication >= 55 THEN 'speech-forward' ELSE 'music-forward' END || ' audio segment, strongest on ' || top || ' semantics.' END AS said FROM g JOIN a USING (event_id) JOIN t USING (event_id)""",
    "staged_outcomes": f"WITH {_STAGED} SELECT odd, state AS status, CASE WHEN state = 'scored' THEN hit END AS from_cache, count(*) AS n, sum(CASE WHEN state = 'scored' AND c1 = '5-low' THEN 1 ELSE 0 END)::BIGINT AS suppressed FROM w GROUP BY ALL",
    "staged_identifiers": f"""WITH {_STAGED}, c AS (SELECT identifier::VARCHAR AS identifier, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT identifier, unnest([c1, c2]) AS code FROM w WHERE state = 'scored') GROUP BY 1)
      SELECT c.identifier AS identifier, any_value(codes) AS codes, sum(id % 3)::BIGINT AS observations, {each(lambda a, i: f'arg_max({a}, odd) AS {a}')} FROM w JOIN c ON c.identifier = w.identifier::VARCHAR WHERE state = 'scored' GROUP BY c.identifier""",
}
