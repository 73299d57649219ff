"""Registered queries on records of any shape, seals, sound features and key columns, with SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import sealed
from tessella.functions.storage import shared_path
from tessella.operators import encoder, records, sync, vectors
from tessella.plans.reports import AXES, app_rows, load, origin_rows, people_rows, visit_rows
from tessella.plans.reports_sql import DAYPART
from tessella.sources import delivery, normalise, quality

SECRET = b"tessella"
#: Embeddings as waves: samples a second, samples of a frame and between frames.
RATE, FRAME, HOP = 1000.0, 32, 16
SOUNDS = ("rms", "dynamic_range", "centroid_hz", "flatness", "rolloff_hz", "zero_cross_rate", "speech_band_ratio", "voicing", "activity")


def _payloads(s: SparkSession, d: str) -> DataFrame:
    """Orders as records of three shapes."""
    i = F.col("o_orderkey")
    nested = F.format_string('{"data": {"items": [{"contentGenre": "%s", "meta": {"channelName": "News 5", "app": {"AppName": "Radio %d"}}}, {"x": 1, "genre": ["Drama", "Comedy"]}]}}', "o_orderpriority", i % 4)
    listed = F.format_string('[{"country": "US", "brand_name": "Auto Store|Cafe", "props": {"k": %d}}]', i % 9)
    single = F.format_string('{"genre": "Live Event; Film", "activation_id": "a%d", "daypart": "Primetime"}', i % 5)
    return load(s, d, "orders").select("o_orderkey", F.when(i % 3 == 0, nested).when(i % 3 == 1, listed).otherwise(single).alias("payload"))


def _event_payloads(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select("user_id", F.concat(F.lit('{"channel": "'), "event_type", F.lit('", "props": '), F.replace("props", F.lit('"k"'), F.lit('"hour"')), F.lit("}")).alias("payload"))


def _sealed(s: SparkSession, d: str) -> DataFrame:
    return _payloads(s, d).select("o_orderkey", sealed.canonical_json("payload").alias("said"), sealed.seal("payload", SECRET).alias("s")).select("o_orderkey", "said", "s.*")


def _keys(s: SparkSession, d: str) -> DataFrame:
    per = lambda name: quality.key_columns(load(s, d, name)).select(F.lit(name).alias("source"), "column", "rows", "nulls", "is_key", "is_user")
    return per("orders").unionByName(per("events"))


def _synced(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as grants of their regions' workspaces; orders as sources, some of them analysed."""
    grants = load(s, d, "nation").select(F.col("n_regionkey").alias("organization_id"), F.col("n_nationkey").alias("activation_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(" ").alias("label"), (F.col("n_nationkey") != 3).alias("is_active"))
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    mark = F.element_at(F.array(*[F.lit(m) for m in ("Activation_ID", "activationid", "ACTIVATION-id", "other")]), (i % 4 + 1).cast("int"))
    key = F.concat(F.lit("r/Web_"), mark, (F.col("o_custkey") % 21).cast("string"), F.lit("_2024.parquet"))
    sources = o.select(i.alias("source_id"), F.col("o_orderpriority").alias("name"), key.alias("object_key"), F.col("o_custkey").cast("string").alias("identifier"), F.lit("web").alias("report_type"))
    scored = o.where(i % 3 > 0).select(i.alias("source_id"), F.col("o_orderdate").alias("created_at"), F.when(i % 5 > 0, F.lit(0.5)).alias("confidence"), *[((i * (n + 2)) % 90).cast("double").alias(a) for n, a in enumerate(AXES)])
    older = scored.withColumns({"created_at": F.col("created_at") - F.expr("interval 1 day"), **{a: F.lit(1.0) for a in AXES}})
    return sync.synced(grants, sources, scored.unionByName(older))


def _regrounded(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector as a source, vectors of labels below 5 as nodes; done twice."""
    base = load(s, d, "embeddings")
    own, i = base.where("vec_id % 50 = 0"), F.col("vec_id")
    sources = own.select(i.alias("source_id"), F.concat(F.lit("s"), (i % 400).cast("string")).alias("name"), F.when(i % 150 > 0, F.lit("http://a/b")).alias("url"))
    near = vectors.knn_cosine(base.where("label < 5"), own, 5)
    tags = own.select(i.alias("source_id"), F.lit(-1).cast("long").alias("node_id"), F.lit(0.5).alias("weight"))
    queue = s.createDataFrame([("s100", 100, "asked")], "symbol string, source_id long, reason string")
    for _ in range(2):
        tags, queue = sync.regrounded(sources, near, tags, queue, 0.35)
    return tags.select("source_id", "node_id", "weight", F.lit("tag").alias("what")).unionByName(queue.select("source_id", F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("weight"), F.concat_ws(":", "symbol", "reason").alias("what")))


def _signals(s: SparkSession, d: str) -> DataFrame:
    per = lambda kind, rows: normalise.normalise_rows(rows, kind).select(F.lit(kind).alias("kind"), "identifier", "signals")
    rows = per("apps", app_rows(s, d)).unionByName(per("demographics", people_rows(s, d))).unionByName(per("origin", origin_rows(s, d)))
    return rows.unionByName(per("visitation", visit_rows(s, d))).groupBy("kind", "identifier", "signals").agg(F.count("*").alias("n"))


def _reread(s: SparkSession, d: str) -> DataFrame:
    """App rows written in four formats, listed, and read back by their keys."""
    root, rows = shared_path(s, "delivered"), app_rows(s, d).drop("key")
    found = None
    for kind in ("parquet", "csv", "json", "orc"):
        at = f"{root}/apps/dt=2024-08-28/{kind}_activation_id7"
        writer = rows.coalesce(1).write.option("header", "true")
        (writer.option("compression", "gzip") if kind in ("csv", "json") else writer).format(kind).save(at)
        read = delivery.read_delivery(s, at, kind, None if kind in ("parquet", "orc") else rows.schema)
        key = F.concat(F.lit("apps/"), F.regexp_extract("object_key", "/apps/(.*)$", 1))
        read = read.select(F.lit(kind).alias("kind"), key.alias("object_key"), F.col("hem"), F.col("CategoryName").alias("category"), F.col("uniques").try_cast("long").alias("uniques"))
        found = read if found is None else found.unionByName(read)
    listed = delivery.list_objects(s, root, ("apps",)).where("bytes > 0")
    per = found.groupBy("kind", "object_key").agg(F.count("*").alias("rows"), F.count("hem").alias("named"), F.countDistinct("category").alias("categories"), F.sum("uniques").alias("uniques"))
    return per.join(listed.select("object_key", "report_type"), "object_key").select("kind", delivery.partition_date("object_key").alias("day"), delivery.activation_id("object_key").alias("activation_id"), "report_type", "rows", "named", "categories", "uniques")


def _row_checks(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey").cast("string")).alias("hem"), *[F.when(F.col("p_partkey") % 7 > 0, F.col(c)).alias(n) for c, n in (("p_type", "CategoryName"), ("p_brand", "TaxonomyName"))], F.when(F.col("p_partkey") % 3 > 0, F.format_string("2024-08-%02dT10", F.col("p_partkey") % 28 + 1)).otherwise("soon").alias("day"))
    return rows.groupBy(normalise.is_summary_row(rows).alias("summary"), normalise.is_roster_row(rows).alias("roster"), normalise.row_day(rows).alias("day")).agg(F.count("*").alias("n"))


def _clean(s: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    identifier = F.when(i % 4 == 0, F.concat(F.lit(" "), i.cast("string"))).when(i % 4 == 1, "").when(i % 4 == 2, F.repeat(F.lit("x"), 513)).otherwise(i.cast("string"))
    tag = lambda code, label, weight: F.struct(code.alias("code"), label.alias("label"), F.lit(None).cast("string").alias("parent_code"), weight.alias("weight"))
    tags = F.array(tag(F.concat(F.lit(" a"), (i % 3).cast("string"), F.lit(" ")), F.repeat(F.col("p_brand"), 40), F.lit(0)), tag(F.when(i % 6 > 0, F.col("p_type")).otherwise(" "), F.col("p_type"), F.lit(3)))
    rows = load(s, d, "part").select(identifier.alias("identifier"), F.col("p_name").alias("label"), tags.cast(f"array<{normalise._TAG}>").alias("tags"), F.array(F.lit("{}")).alias("signals"), (i % 3).cast("double").alias("confidence"))
    first, size = F.get("tags", F.lit(0)), F.size("tags")
    return normalise.clean_rows(rows).select("identifier", "label", size.alias("n_tags"), first["code"].alias("code"), F.length(first["label"]).alias("label_length"), first["weight"].alias("weight"), "confidence")


def _probed(s: SparkSession, d: str) -> DataFrame:
    """The report on app rows, with what a later one says of people's rows for the same checks."""
    apps = quality.probe(app_rows(s, d), "apps")
    return quality.merged_report(apps, quality.probe(people_rows(s, d), "demographics").where("check <> 'yield'"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "record_signals": lambda s, d: records.signals(_event_payloads(s, d), "user_id"),
    "record_insights": lambda s, d: records.insights(_payloads(s, d), "o_orderkey"),
    "sealed_records": _sealed,
    "key_columns": _keys,
    "delivery_signals": _signals,
    "reread_deliveries": _reread,
    "row_checks": _row_checks,
    "clean_tasks": _clean,
    "delivery_probe": _probed,
    "workspace_records": lambda s, d: _synced(s, d)[0],
    "workspace_datasets": lambda s, d: _synced(s, d)[1].withColumns({a: F.round(a, 4) for a in AXES}),
    "regrounded": _regrounded,
    "sound_features": lambda s, d: encoder.encoded(load(s, d, "embeddings"), "embedding", RATE, FRAME, HOP).select("vec_id", *SOUNDS),
}

#: The nested loop that the join of patterns stands for.
_SYNCED = f"""g AS (SELECT n_regionkey AS organization_id, n_nationkey::VARCHAR AS activation_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Activation ' || n_nationkey END AS dataset FROM nation WHERE n_nationkey <> 3),
  o AS (SELECT *, 'r/Web_' || (['Activation_ID', 'activationid', 'ACTIVATION-id', 'other'])[o_orderkey % 4 + 1] || (o_custkey % 21) || '_2024.parquet' AS k, o_orderkey % 3 > 0 AS done FROM orders),
  r AS (SELECT organization_id, activation_id, dataset, o_orderkey AS source_id, o_custkey::VARCHAR AS external_user_id, o_orderpriority AS source_name, CASE WHEN done THEN 'scored' ELSE 'pending' END AS status, CASE WHEN done THEN CASE WHEN o_orderkey % 5 > 0 THEN 0.5 ELSE 1.0 END END AS confidence,
    {', '.join(f'CASE WHEN done THEN (o_orderkey * {n + 2} % 90)::DOUBLE END AS {a}' for n, a in enumerate(AXES))} FROM g JOIN o ON k ILIKE '%activation_id' || activation_id || '%' OR k ILIKE '%activationid' || activation_id || '%' OR k ILIKE '%activation-id' || activation_id || '%')"""
_KEY = (hashlib.sha256(SECRET).digest() if len(SECRET) > 64 else SECRET).ljust(64, b"\0")
_PAD = lambda x: f"unhex('{bytes(b ^ x for b in _KEY).hex()}')"
_HALF = lambda x, digits: f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"
_TILT = lambda a: " + ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN {float(t[a])} ELSE 0 END" for p, t in records.TILTS if a in t) or "0"
_ANY = " OR ".join(f"regexp_matches(l, '{p}')" for p, _ in records.TILTS)
_COUNTS = lambda name, columns, user: " UNION ALL ".join(f"SELECT '{name}' AS source, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) = count(*) AS is_key, {str(c == user).lower()} AS is_user FROM {name}" for c in columns)

ORACLE_SQL: dict[str, str] = {
    "record_signals": "SELECT user_id, 'channel' AS kind, event_type AS label, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT user_id, 'daypart', json_extract_string(props, '$.k'), count(*) FROM events WHERE props IS NOT NULL GROUP BY 1, 3",
    "record_insights": f"""WITH s AS (SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['genre', 'channel', 'app', 'genre', 'genre'] WHEN 1 THEN ['geo', 'brand', 'brand'] ELSE ['genre', 'genre', 'audience', 'daypart'] END) AS kind,
        unnest(CASE o_orderkey % 3 WHEN 0 THEN [lower(o_orderpriority), 'news 5', 'radio ' || (o_orderkey % 4), 'drama', 'comedy'] WHEN 1 THEN ['us', 'auto store', 'cafe'] ELSE ['live event', 'film', 'a' || (o_orderkey % 5), 'primetime'] END) AS l FROM orders),
      t AS (SELECT o_orderkey, count(*) AS signals, count(*) FILTER ({_ANY}) AS matched, count(*) FILTER (NOT ({_ANY}) AND kind <> 'audience') AS unmapped, {', '.join(f'sum((log10(2) + 1) * ({_TILT(a)})) AS {a}' for a in AXES)} FROM s GROUP BY 1),
      h AS (SELECT *, greatest(1, matched / 2) AS half FROM t)
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS records, signals, matched, unmapped, {', '.join(f'greatest(0.0, least(100.0, floor(50 + round({a} / half, 9) + 0.5))) AS {a}, floor(round({a} / half, 9) * 10 + 0.5) / 10 AS {a}_tilt' for a in AXES)} FROM h""",
    "sealed_records": f"""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{{"data":{{"items":[{{"contentGenre":"' || o_orderpriority || '","meta":{{"app":{{"AppName":"Radio ' || (o_orderkey % 4) || '"}},"channelName":"News 5"}}}},{{"genre":["Drama","Comedy"],"x":1}}]}}}}'
        WHEN 1 THEN '[{{"brand_name":"Auto Store|Cafe","country":"US","props":{{"k":' || (o_orderkey % 9) || '}}}}]' ELSE '{{"activation_id":"a' || (o_orderkey % 5) || '","daypart":"Primetime","genre":"Live Event; Film"}}' END AS said FROM orders)
      SELECT o_orderkey, said, substr(sha256(said), 1, 32) AS subject, sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(said)))) AS signature FROM p""",
    "key_columns": _COUNTS("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), None) + " UNION ALL " + _COUNTS("events", ("event_id", "ts", "user_id", "event_type", "value", "props"), "user_id"),
    "sound_features": f"""WITH s AS (SELECT vec_id, f, i, embedding[f * {HOP} + i + 1]::DOUBLE AS x FROM embeddings, range(3) r(f), range({FRAME}) q(i)),
      e AS (SELECT vec_id, f, sqrt(avg(x * x)) AS rms, sum(x * x) AS energy, count(*) FILTER ((x >= 0) <> (b >= 0)) AS zc FROM (SELECT *, lag(x) OVER (PARTITION BY vec_id, f ORDER BY i) AS b FROM s) GROUP BY 1, 2),
      m AS (SELECT vec_id, f, k, sqrt(sum(y * cos(2 * pi() * k * i / {FRAME})) ** 2 + sum(y * sin(2 * pi() * k * i / {FRAME})) ** 2) AS m FROM (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * i / {FRAME - 1})) AS y FROM s), range({FRAME // 2}) z(k) GROUP BY 1, 2, 3),
      c AS (SELECT *, k * {RATE} / {FRAME} AS hz, sum(m) OVER (PARTITION BY vec_id, f) AS total, sum(m) OVER (PARTITION BY vec_id, f ORDER BY k) AS run FROM m),
      t AS (SELECT vec_id, f, sum(m * hz) / any_value(total) AS centroid, least(1.0, exp(avg(ln(m + 1e-9))) / avg(m)) AS flat, min(hz) FILTER (run >= 0.85 * total * (1 - 1e-12)) AS rolloff, coalesce(sum(m) FILTER (hz BETWEEN 300 AND 3400), 0) / any_value(total) AS band FROM c GROUP BY 1, 2),
      a AS (SELECT vec_id, f, greatest(0, max(v)) AS v FROM (SELECT a.vec_id, a.f, lag, sum(a.x * b.x) AS v FROM s a JOIN range(2, 17) l(lag) ON TRUE JOIN s b ON a.vec_id = b.vec_id AND a.f = b.f AND b.i = a.i + lag GROUP BY 1, 2, 3) GROUP BY 1, 2)
      SELECT vec_id, {_HALF('least(1.0, avg(rms))', 3)} AS rms, {_HALF('max(rms) - min(rms)', 3)} AS dynamic_range, {_HALF('avg(centroid)', 0)} AS centroid_hz, {_HALF('avg(flat)', 3)} AS flatness, {_HALF('avg(rolloff)', 0)} AS rolloff_hz, {_HALF('sum(zc) / 0.064', 0)} AS zero_cross_rate, {_HALF('avg(band)', 3)} AS speech_band_ratio, {_HALF('avg(least(1.0, v / energy))', 3)} AS voicing, 1.0 AS activity
      FROM e JOIN t USING (vec_id, f) JOIN a USING (vec_id, f) GROUP BY 1""",
    "workspace_records": f"WITH {_SYNCED} SELECT * FROM r",
    "workspace_datasets": f"WITH {_SYNCED} SELECT g.organization_id, g.activation_id, g.dataset, CASE WHEN count(source_id) > 0 THEN 'done' ELSE 'empty' END AS status, count(source_id) AS row_count, count(confidence) AS scored_count, coalesce(round(count(confidence) / nullif(count(source_id), 0) * 100, 2), 0) AS coverage_pct, {', '.join(f'round(avg({a}), 4) AS {a}' for a in AXES)} FROM g LEFT JOIN r USING (organization_id, activation_id) GROUP BY 1, 2, 3",
    "regrounded": """WITH s AS (SELECT *, vec_id % 150 > 0 AS heard FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT s.vec_id AS source_id, b.vec_id AS node_id, heard, round(list_cosine_similarity(s.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS v FROM s JOIN embeddings b ON b.label < 5 AND b.vec_id <> s.vec_id),
      n AS (SELECT source_id, node_id, floor(v * 1000 + 0.5) / 1000 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY v DESC, node_id) AS r FROM c) WHERE r <= 5 AND v >= 0.35 AND heard)
      SELECT source_id, node_id, weight, 'tag' AS what FROM n UNION ALL SELECT vec_id, -1, 0.5, 'tag' FROM s WHERE vec_id NOT IN (SELECT source_id FROM n)
      UNION ALL SELECT min(vec_id), NULL, NULL, 's' || (vec_id % 400) || ':no match' FROM s WHERE heard AND vec_id % 400 <> 100 AND vec_id NOT IN (SELECT source_id FROM n) GROUP BY vec_id % 400 UNION ALL SELECT 100, NULL, NULL, 's100:asked'""",
    "delivery_signals": f"""WITH r AS (
      SELECT 'apps' AS kind, p_partkey::VARCHAR AS identifier, '{{"CategoryName":"' || p_type || '","TaxonomyName":"' || p_brand || '","Signals":' || CASE WHEN p_size > 5 THEN (p_size - 5) || '.0' ELSE 'null' END || ',"meta":{{"bundle_id":"","platform":""}}}}' AS signals FROM part WHERE p_partkey % 5 > 0
      UNION ALL SELECT 'demographics', c_custkey::VARCHAR, '{{"age_band":"' || (c_nationkey * 3) || '-99","income_band":"' || CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 1000)::INT::VARCHAR ELSE '' END || '","household":"' || lower(c_mktsegment) || '","meta":{{"segment_codes":[]}}}}' FROM customer
      UNION ALL SELECT 'origin', s_suppkey::VARCHAR, '{{"origin_class":"Urban Core","region":"' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || '","travel":"' || CASE WHEN s_acctbal > 5000 THEN 'long-haul' ELSE '' END || '","meta":{{"country":"","provider":""}}}}' FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT 'visitation', user_id::VARCHAR, '{{"brandName":"' || CASE WHEN event_type <> 'error' THEN 'Brand ' || event_type ELSE '' END || '","visited_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","daypart":"' || {DAYPART} || '","distance":' || CASE WHEN event_id % 4 > 0 THEN value::VARCHAR ELSE 'null' END || ',"meta":{{"poi_id":""}}}}' FROM events)
      SELECT kind, identifier, signals, count(*) AS n FROM r GROUP BY ALL""",
    "reread_deliveries": "SELECT unnest(['parquet', 'csv', 'json', 'orc']) AS kind, DATE '2024-08-28' AS day, '7' AS activation_id, 'apps' AS report_type, count(*) AS rows, count(*) FILTER (p_partkey % 5 > 0) AS named, count(DISTINCT p_type) AS categories, sum(p_size)::BIGINT AS uniques FROM part",
    "row_checks": "SELECT p_partkey % 5 = 0 AND p_partkey % 7 > 0 AS summary, p_partkey % 5 > 0 AND p_partkey % 7 = 0 AS roster, CASE WHEN p_partkey % 3 > 0 THEN '2024-08-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS day, count(*) AS n FROM part GROUP BY ALL",
    "clean_tasks": "SELECT p_partkey::VARCHAR AS identifier, p_name AS label, CASE WHEN p_partkey % 6 > 0 THEN 2 ELSE 1 END AS n_tags, 'a' || (p_partkey % 3) AS code, least(300, 40 * length(p_brand)) AS label_length, 1 AS weight, CASE p_partkey % 3 WHEN 0 THEN 0.5 ELSE 1.0 END AS confidence FROM part WHERE p_partkey % 4 IN (0, 3)",
    "delivery_probe": "SELECT 'yield' AS \"check\", CASE WHEN s >= 0.8 THEN 'pass' WHEN s > 0 THEN 'warn' ELSE 'fail' END AS status, s::VARCHAR AS said FROM (SELECT round(count(*) FILTER (p_partkey % 5 > 0) / count(*), 4) AS s FROM part) UNION ALL SELECT 'groups', 'pass', '' UNION ALL SELECT 'unknown columns', 'pass', '' UNION ALL SELECT 'identifiers', 'pass', round(count(c_custkey) / count(*), 4)::VARCHAR FROM customer",
}
