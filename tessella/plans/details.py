"""Registered queries on gaps and insights of tags, sweeps, backfills, musical shares and divergence, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import algebra, audio, insights, lifecycle
from tessella.plans.reports import AXES, _nth, analyses, load, profiles
from tessella.plans.reports_sql import A, P

NOW, LATER = "1998-06-01 00:00:00", "1998-06-02 00:00:00"


def _gaps(s: SparkSession, d: str) -> DataFrame:
    """Parts as nodes, order lines as tags of their suppliers."""
    code = F.lower(F.concat_ws(".", "p_type", "p_brand"))
    parts = load(s, d, "part").select("p_partkey", code.alias("code"), "p_name", "p_size")
    nodes = parts.groupBy("code").agg(F.min("p_name").alias("label"), (F.max("p_size") > 49).alias("suppressed"), F.count_if(F.col("p_size") < 3).alias("grounding_count"))
    tags = load(s, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("source_id"), "code", F.col("l_quantity").alias("weight"))
    queue = nodes.select("code", F.when(F.contains("code", F.lit("#1")), "pending").otherwise("done").alias("status"))
    assets = nodes.select("code", F.when(F.startswith("code", F.lit("promo")), "active").otherwise("old").alias("status"))
    return insights.grounding_gaps(nodes, tags, queue, assets, 500).unionByName(insights.grounding_gaps(nodes, tags, queue, assets, 3, "large"))


def _insights(s: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    codes = F.array(F.concat(F.lit("demo.age."), F.floor(k / 10).cast("string")), F.concat(F.lit("ctv.genre."), "event_type"), F.concat(F.lit("iab"), (k % 7).cast("string")), F.concat(F.lit("x."), (k % 40).cast("string")))
    per = load(s, d, "events").groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list(codes))).alias("codes"))
    rows = per.join(profiles(s, d), "user_id").withColumn("codes", F.when(F.col("user_id") % 11 > 0, F.col("codes")).otherwise(F.array()))
    return insights.tag_insights(rows.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 100)).select("codes", *[F.round(a, 3).alias(a) for a in AXES], "confidence"), AXES, 8)


def _sweeps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as old sweeps, and as analyses and their sources; then a day of sweeps."""
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    old = o.select(i.cast("long").alias("sweep_id"), _nth("o_orderkey", ("done", "failed")).alias("status"), F.lit(100).alias("batch_size"), F.lit(None).cast("string").alias("note"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    rows = o.select(i.alias("source_id"), _nth("o_orderkey", ("text-only", "grounded", "text-only")).alias("grounding_level"))
    sources = o.select(i.alias("source_id"), (i % 5 > 0).alias("has_vector"), F.when(i % 4 > 0, F.col("o_orderdate")).alias("checked_at"))
    pending = lifecycle.rescore_pending(rows, sources, NOW, 24 * 365)
    sweeps = lifecycle.autostarted_sweeps(old, pending, NOW)
    sweeps = lifecycle.controlled_sweeps(lifecycle.autostarted_sweeps(sweeps, pending, LATER), "pause", LATER)
    sweeps = lifecycle.controlled_sweeps(lifecycle.controlled_sweeps(sweeps, "restart", LATER, 900), "start", LATER, 0)
    return sweeps, lifecycle.sweep_status(sweeps, pending)


def _backfilled(s: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    key = F.when(i % 2 == 0, F.concat(F.lit("r/x_Activation-ID"), (F.col("o_custkey") % 9).cast("string"), F.lit("_y.csv"))).otherwise("none")
    return lifecycle.backfilled_activations(load(s, d, "orders").select(i.alias("id"), key.alias("object_key"), F.when(i % 3 == 0, "kept").alias("activation_id")), 50)


def _music(s: SparkSession, d: str) -> DataFrame:
    tags = load(s, d, "part").select("p_size", F.lower("p_type").alias("code"), _nth("p_partkey", ("Piano music", "Speech", "Male voice singing", "Dog")).alias("label"), (F.col("p_partkey") % 10 / 10 - 0.2).alias("similarity"))
    return audio.music_share(tags, "p_size").withColumn("musical", F.round("musical", 4))


def _pretty(s: SparkSession, d: str) -> DataFrame:
    i = F.col("c_custkey").cast("string")
    codes = F.array(F.concat(F.lit("demo.age."), i), F.concat(F.lit("demo.age."), i, F.lit("-99")), F.concat(F.lit("demo.income.low_"), i), F.concat(F.lit("ctv.genre.sci-fi__"), i), F.concat(F.lit("iab.iab1-"), i), F.concat(F.lit("x.y_"), i))
    rows = load(s, d, "customer").select("c_custkey", F.element_at(codes, (F.col("c_custkey") % 6 + 1).cast("int")).alias("code"))
    return rows.select("c_custkey", S.pretty_tag("code").alias("pretty"), S.leaf_label("code").alias("leaf"))


def _divergence(s: SparkSession, d: str) -> DataFrame:
    own = profiles(s, d).select("user_id", *AXES)
    return algebra.divergence(own, own.select("user_id", *[(F.col("user_id") * (i + 2) % 80).cast("double").alias(a) for i, a in enumerate(AXES)]), "user_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "grounding_gaps": _gaps,
    "tag_insights": _insights,
    "rescore_sweeps": lambda s, d: _sweeps(s, d)[0].groupBy("status", "batch_size", "note").agg(F.count("*").alias("n"), F.max("sweep_id").alias("last")),
    "sweep_status": lambda s, d: _sweeps(s, d)[1].select("sources_with_vector", "text_only_with_vector", "pending", "sweep_id", "status", "batch_size"),
    "backfilled_activations": _backfilled,
    "music_shares": _music,
    "pretty_tags": _pretty,
    "axis_divergence": _divergence,
    "trail_means": lambda s, d: algebra.trail_means(analyses(s, d), "user_id").select("user_id", *[F.round(a, 9).alias(a) for a in AXES]),
}

_PAIRS = f"(SELECT user_id, unnest({AXES}) AS axis, unnest(range(6)) AS i, unnest([{', '.join(f'round(abs({a} - user_id * {i + 2} % 80), 9)' for i, a in enumerate(AXES))}]) AS delta FROM {P})"
_GAPS = """p AS (SELECT *, lower(p_type || '.' || p_brand) AS code FROM part), n AS (SELECT code, min(p_name) AS label FROM p GROUP BY 1 HAVING max(p_size) <= 49 AND min(p_size) >= 3 AND NOT starts_with(code, 'promo')),
  g AS (SELECT code, any_value(n.label) AS label, split_part(code, '.', 1) AS branch, count(DISTINCT l_suppkey) AS observed_sources, round(sum(l_quantity), 3) AS observed_weight, contains(code, '#1') AS queued FROM lineitem JOIN p ON l_partkey = p_partkey JOIN n USING (code) GROUP BY code)"""
_OLD = "(SELECT o_orderkey AS source_id, o_orderkey % 4 = 0 OR o_orderdate < TIMESTAMP '1997-06-01' AS old FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 <> 1)"

ORACLE_SQL: dict[str, str] = {
    "grounding_gaps": f"WITH {_GAPS} (SELECT * FROM g ORDER BY observed_weight DESC, code LIMIT 200) UNION ALL (SELECT * FROM g WHERE branch = 'large' ORDER BY observed_weight DESC, code LIMIT 3)",
    "tag_insights": f"""WITH e AS (SELECT *, coalesce(json_extract(props, '$.k')::INT, 0) AS k FROM events WHERE user_id % 11 > 0), t AS (SELECT DISTINCT user_id, unnest(['demo.age.' || (k // 10), 'ctv.genre.' || event_type, 'iab' || (k % 7), 'x.' || (k % 40)]) AS code FROM e),
      c AS (SELECT code, CASE WHEN starts_with(code, 'demo.age.') THEN 'age' WHEN starts_with(code, 'ctv') THEN 'viewing genre' WHEN starts_with(code, 'iab') THEN 'interest category' ELSE 'other signals' END AS family, count(*) AS n, {', '.join(f'round(avg(round({a}, 3)), 1) AS {a}' for a in AXES)}, round(avg(least(1.0, n / 100)), 3) AS confidence FROM t JOIN {P} USING (user_id) GROUP BY 1, 2),
      r AS (SELECT *, count(*) OVER (PARTITION BY family) AS family_tags, sum(n) OVER (PARTITION BY family)::BIGINT AS family_mentions, row_number() OVER (PARTITION BY family ORDER BY n DESC, code) AS rank FROM c)
      SELECT *, round(n / (SELECT count(DISTINCT user_id) FROM t) * 100, 1) AS share FROM r WHERE rank <= 8""",
    "rescore_sweeps": f"""WITH m AS (SELECT max(o_orderkey) AS m FROM orders), w AS (SELECT count(*) FILTER (old) > 0 AS work FROM {_OLD})
      SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'failed' END AS status, 100 AS batch_size, NULL AS note, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1
      UNION ALL SELECT 'done', 200, 'auto-started for newly grounded audiences', 1, m + 1 FROM m, w WHERE work UNION ALL SELECT 'running', 1, NULL, 1, m + CASE WHEN work THEN 2 ELSE 1 END FROM m, w""",
    "sweep_status": f"SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 > 0) AS sources_with_vector, count(*) AS text_only_with_vector, count(*) FILTER (old) AS pending, (SELECT max(o_orderkey) FROM orders) + CASE WHEN count(*) FILTER (old) > 0 THEN 2 ELSE 1 END AS sweep_id, 'running' AS status, 1 AS batch_size FROM {_OLD}",
    "backfilled_activations": "WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'r/x_Activation-ID' || (o_custkey % 9) || '_y.csv' ELSE 'none' END AS object_key, (o_custkey % 9)::VARCHAR AS told FROM orders), b AS (SELECT id FROM q WHERE id % 3 > 0 AND id % 2 = 0 ORDER BY id LIMIT 50) SELECT id, object_key, CASE WHEN id % 3 = 0 THEN 'kept' WHEN id IN (SELECT id FROM b) THEN told END AS activation_id FROM q",
    "music_shares": "WITH t AS (SELECT p_size, p_partkey % 4 AS k, greatest(0, p_partkey % 10 / 10 - 0.2) AS w FROM part), s AS (SELECT p_size, sum(CASE WHEN k IN (0, 2) THEN w ELSE 0 END) AS m, sum(CASE WHEN k IN (1, 2) THEN w ELSE 0 END) AS v FROM t GROUP BY 1) SELECT p_size, CASE WHEN m + v > 0 THEN round(m / (m + v), 4) END AS musical FROM s",
    "pretty_tags": "SELECT c_custkey, (['' || c_custkey || '+', c_custkey || ' 99', 'income.low ' || c_custkey, 'sci fi ' || c_custkey, 'IAB iab1 ' || c_custkey, 'x.y ' || c_custkey])[c_custkey % 6 + 1] AS pretty, (['' || c_custkey, c_custkey || ' 99', 'low ' || c_custkey, 'sci fi  ' || c_custkey, 'iab1 ' || c_custkey, 'y ' || c_custkey])[c_custkey % 6 + 1] AS leaf FROM customer",
    "axis_divergence": f"SELECT user_id, axis, delta, r <= 3 AND delta >= 8 AS divergent, floor(greatest(0, least(1, 1 - total / 6 / 100)) * 100 + 0.5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, i) AS r, sum(delta) OVER (PARTITION BY user_id) AS total FROM {_PAIRS})",
    "trail_means": f"SELECT user_id, {', '.join(f'round(avg({a}), 9) AS {a}' for a in AXES)} FROM {A} GROUP BY 1",
}
