"""Registered queries on taxonomies, catalogues, audio features, scoring and site tags, with SQL.

Nations and their customers stand in for a catalogue, parts for a taxonomy, daily events for
audio frames, pages and orders for beacons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import audio, catalogue, insights, profiles, scoring, taxonomy, vectors
from tessella.plans.reports import AXES, _nth, load, tasks
from tessella.plans.reports import cache as cached_scores
from tessella.plans.reports_sql import AXES as SQL_AXES
from tessella.plans.reports_sql import HALF_UP, T, C, each, nth
from tessella.sources import beacons

PROVIDERS = {"stream": "stream", "ctv": "ctv", "data": "data"}


def _words(column: str) -> F.Column:
    return F.replace(F.lower(F.col(column)), F.lit(" "), F.lit("_"))


def places(s: SparkSession, d: str) -> DataFrame:
    label = _nth("p_partkey", ("City Hospital", "Coffee shop", "St. Mary church", "Food bank", "Gym"))
    code = F.concat(_nth("p_size", ("visit.brand.", "iab.", "POI.x.", "web.topic.")), F.replace(F.lower(label), F.lit(" "), F.lit("_")))
    return load(s, d, "part").select("p_partkey", code.alias("code"), label.alias("label"))


def tree(s: SparkSession, d: str) -> DataFrame:
    """Regions over nations over customers; one region is left out."""
    r = load(s, d, "region").where("r_regionkey > 0").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent_id"))
    n = load(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    c = load(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"))
    return r.unionByName(n).unionByName(c)


def items(s: SparkSession, d: str) -> DataFrame:
    """Regions as labels, nations as albums, customers as tracks."""
    kind = F.when(F.startswith("id", F.lit("r")), "label").when(F.startswith("id", F.lit("n")), "album").otherwise("track")
    key = F.substring("id", 2, 9).cast("int")
    track = kind == "track"
    marks = F.when(track & (key % 3 > 0), F.array(F.concat(F.lit("s"), (key % 5).cast("string")), F.concat(F.lit(" s"), (key % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return tree(s, d).select("id", "parent_id", F.col("label").alias("title"), kind.alias("kind"), marks.alias("symbols"), F.when(track & (key % 4 > 0), (key % 101).cast("double")).alias("score"), F.when(track & (key % 2 == 0), key).alias("source_id"), F.when(key % 6 > 0, 2000 + key % 20).alias("release_year"))


def ontology(s: SparkSession, d: str) -> DataFrame:
    """Each number has its double and the next to it as children; names repeat."""
    ids = load(s, d, "orders").where("o_orderkey < 200").select(F.col("o_orderkey").alias("i"))
    name = F.concat(F.lit("Sound "), (F.col("i") % 60).cast("string"))
    child = lambda c: c.cast("string")
    return ids.select(F.col("i").cast("string").alias("id"), name.alias("name"), F.when(F.col("i") > 0, F.array(child(F.col("i") * 2), child(F.col("i") * 2 + 1), child(F.col("i") * 3))).otherwise(F.array().cast("array<string>")).alias("child_ids"))


def frames(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    chroma = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("event_id") + i * i) % 12).cast("double") / 12)
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") % 1).alias("rms"), (F.col("value") * 100).alias("centroid_hz"), chroma.alias("chroma"), "value")


def features(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    v, i = F.col("value"), F.col("event_id")
    return e.select(
        "event_id", (i % 20).cast("double").alias("duration_s"), (v % 1).alias("rms"), ((i % 40) / 100).alias("dynamic_range"), (v * 60).alias("centroid_hz"), F.when(i % 9 > 0, (i % 70) / 100).alias("flatness"),
        (v * 100).alias("rolloff_hz"), ((i % 13) / 12).alias("speech_ratio"), ((i % 7) / 5).alias("voicing"), ((i % 11) - 2).cast("double").alias("onset_rate"), ((i % 5) / 4).alias("activity"),
    )


def measured(s: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    v = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: F.abs(x.cast("double")))
    return load(s, d, "embeddings").select(
        "vec_id", v(1, 12).alias("chroma"), v(13, 6).alias("tonnetz"), F.transform(v(19, 7), lambda x: x * 40).alias("contrast"), F.transform(v(26, 13), lambda x: x * 40).alias("mfcc"), ((i % 10) / 10).alias("flatness"), F.when(i % 6 > 0, (i % 300).cast("double")).alias("tempo"),
        ((i % 9) / 8).alias("beat_regularity"), (i % 14).cast("double").alias("onset_rate"), (i * 20.0).alias("centroid_hz"), (i * 30.0).alias("rolloff_hz"), ((i % 4) / 10).alias("zero_crossing"), _nth("vec_id", ("grounded", "bridged", "partial")).alias("grounding_level"),
        ((i % 11) / 10).alias("confidence"), F.when(i % 5 > 0, F.transform(F.slice("embedding", 40, 4), lambda x: x.cast("double"))).alias("similarities"),
    )


def spectra(s: SparkSession, d: str) -> DataFrame:
    return audio.spectrum_axes(load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("spectrum"))).select("vec_id", *AXES)


def described(s: SparkSession, d: str) -> DataFrame:
    rows = audio.window_features(frames(s, d), "user_id", "ts", "1 day", order="event_id").withColumns({a: ((F.col("user_id") * (i + 3)) % 90).cast("double") for i, a in enumerate(AXES)})
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), audio.described(rows).alias("said"))


def _crosswalk(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    near = vectors.knn_cosine(e.where("label >= 6"), e.where("label < 6 and vec_id % 5 = 0"), 6)
    code = lambda c: F.concat(_nth(c, ("iab.", "ctv.", "app.")), F.col(c).cast("string"))
    return near.select(code("query_id").alias("code"), F.concat(F.lit("aset."), F.col("neighbour_id").cast("string")).alias("target"), "similarity", F.col("query_id"), F.col("neighbour_id"))


def _decided(rows: DataFrame) -> DataFrame:
    return rows.select("code", "target", (F.col("neighbour_id") % 11 == 0).alias("approved"), (F.col("neighbour_id") % 11 == 1).alias("rejected"))


def _matches(s: SparkSession, d: str) -> DataFrame:
    rows = _crosswalk(s, d)
    return taxonomy.propose_matches(rows, _decided(rows), 3)


def rollups(s: SparkSession, d: str) -> DataFrame:
    rolled = profiles.rollup_tags(profiles.event_tags(load(s, d, "events")))
    return rolled.select(F.lit("f").alias("object_key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), "code", "weight")


def _materialised(s: SparkSession, d: str) -> dict[str, DataFrame]:
    known = tasks(s, d).where("identifier % 4 = 0").groupBy("identifier").agg(F.lit(2).cast("long").alias("observations"), F.array(F.lit("old"), F.lit("status.f")).alias("codes"))
    return scoring.materialised(tasks(s, d), cached_scores(s, d), known)


def _by_name(s: SparkSession, d: str) -> DataFrame:
    records = load(s, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("source_name"))
    axes = [((F.col("c_custkey") * (i + 2)) % 97).cast("double").alias(a) for i, a in enumerate(AXES)]
    rows = load(s, d, "customer").select(F.concat(F.lit("s"), (F.col("c_custkey") % 40).cast("string")).alias("source_name"), F.col("c_custkey").alias("created_at"), F.lit(0.7).alias("confidence"), *axes, (F.col("c_custkey") % 40).alias("k"))
    return scoring.scores_by_name(records, rows.where("k < 15"), rows.where("k >= 10 and k < 30"))


def sources(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "part")
    kind = _nth("p_partkey", ("web stream", "CTV feed", "raw data", "x", "y"))
    url = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("http://h/a.b/"), F.col("p_partkey").cast("string"), F.lit(".MP3?x=1.wavy")))
    return catalogue.facets(p.select("p_partkey", kind.alias("source_type"), url.alias("file_url"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 40, F.lit("Evening News")).alias("album_name")), PROVIDERS, ("ctv", "data"), ("stream",))


def beacon_rows(pages: DataFrame) -> DataFrame:
    i = F.col("page_id")
    return pages.select(
        "page_id", F.when(i % 13 > 0, F.concat(F.lit("t"), (i % 4).cast("string"))).alias("tag_id"), F.when(i % 3 > 0, F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)).alias("origin"), _nth("page_id", ("ctr", "reach", "odd")).alias("metric"),
        _nth("page_id", ("1.5", "", "x", "7")).alias("value"), F.col("url").alias("page_url"),
    )


def site_tags(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("t0", True, []), ("t1", True, ["https://example.com/", "example.net"]), ("t2", False, []), ("t3", None, None)], "tag_id string, active boolean, allowed_origins array<string>")


def _beacons(s: SparkSession, d: str) -> DataFrame:
    return beacons.collected(beacon_rows(load(s, d, "pages")), site_tags(s), ("ctr", "reach")).select("page_id", "problem", "number", "utm_source")


def _imports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    rows = o.select(i.alias("row"), F.concat(F.lit("d"), (F.col("o_custkey") % 30).cast("string")).alias("device_id"), F.lower("o_orderstatus").alias("metric"), F.when(i % 9 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("value"), F.when(i % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.when(i % 10 == 0, "soon").otherwise("")).alias("occurred_at"))
    return beacons.imported(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sensitive_places": lambda s, d: places(s, d).select("p_partkey", taxonomy.is_sensitive(F.col("code"), F.col("label")).alias("sensitive"), taxonomy.family_key(F.col("code")).alias("family")),
    "prefix_codes": lambda s, d: places(s, d).where(taxonomy.has_prefix(F.col("code"), ("visit.", "iab."))).groupBy("code").agg(F.count("*").alias("n")),
    "named_tags": lambda s, d: (lambda kept, new: kept.select("code").withColumn("kind", F.lit("kept")).unionByName(new.select("code").withColumn("kind", F.lit("new"))).groupBy("kind", "code").agg(F.count("*").alias("n")))(*taxonomy.named(places(s, d).where("p_partkey % 3 = 0").groupBy("code").agg((F.min("p_partkey") % 2 == 0).alias("suppressed")), places(s, d).select("code", "label"))),
    "grounding_counts": lambda s, d: taxonomy.grounding_counts(places(s, d).groupBy("code").agg((F.count("*") % 5).alias("grounding_count")), places(s, d).select((F.col("p_partkey") % 40).alias("source_id"), "code"), s.range(40).select(F.col("id").alias("source_id"), (F.col("id") % 2 == 0).alias("complete"), (F.col("id") % 3 > 0).alias("embedded"))),
    "ontology_tree": lambda s, d: taxonomy.ontology_tree(ontology(s, d)),
    "path_nodes": lambda s, d: taxonomy.path_nodes(load(s, d, "part").select(F.concat_ws(" > ", "p_type", "p_brand", (F.col("p_size") % 5).cast("string")).alias("path"))),
    "tree_parents": lambda s, d: taxonomy.with_parents(tree(s, d)).where("synthesised or parent_id is null").select("id", "synthesised"),
    "tree_search": lambda s, d: taxonomy.filtered_tree(tree(s, d), "nation_1").select("id", "label"),
    "subtree_sizes": lambda s, d: taxonomy.subtree_sizes(tree(s, d)).where("nodes > 1"),
    "crosswalk_matches": lambda s, d: _matches(s, d),
    "crosswalk_approved": lambda s, d: taxonomy.auto_approved(_matches(s, d), 0.15),
    "crosswalk_coverage": lambda s, d: taxonomy.crosswalk_coverage(load(s, d, "embeddings").where("label < 6").select(F.concat(_nth("vec_id", ("iab.", "ctv.", "app.")), F.col("vec_id").cast("string")).alias("code")), _matches(s, d), ("iab.", "ctv.")),
    "originality_rollup": lambda s, d: catalogue.originality_rollup(items(s, d)),
    "label_ranking": lambda s, d: catalogue.label_ranking(items(s, d), load(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 90).cast("double")).otherwise(0.5).alias("confidence"), _nth("c_custkey", ("grounded", "odd", "weak")).alias("grounding_level"))),
    "library_facets": lambda s, d: catalogue.facet_counts(sources(s, d), "provider", "kind", "content", "file_type"),
    "library_page": lambda s, d: catalogue.page(catalogue.chosen(sources(s, d), kind="audio", provider="all").where(catalogue.optional("provider", None)), F.desc("name"), F.col("p_partkey"), offset=10, most=20).select("p_partkey", "provider", "file_type"),
    "tag_frequencies": lambda s, d: catalogue.tag_frequencies(tasks(s, d), "codes"),
    "accented_search": lambda s, d: insights.search(load(s, d, "part").withColumn("t", F.translate("p_name", "eao", "éàö")), "ECONÔMY brÁnd", "t", "p_type", "p_brand").select("p_partkey"),
    "feature_axes": lambda s, d: audio.axes_from_features(audio.sanitised(features(s, d))).select("event_id", *AXES, "confidence"),
    "spectrum_axes": spectra,
    "musical_scores": lambda s, d: audio.musical_scores(measured(s, d), F.when(F.col("vec_id") % 3 == 0, (F.col("vec_id") % 5) / 5)).select("vec_id", "pitch", "rhythm", "timbre", "musicality"),
    "originality": lambda s, d: audio.originality(audio.musical_scores(measured(s, d))).select("vec_id", "originality", "evidence"),
    "feature_windows": lambda s, d: audio.window_features(frames(s, d), "user_id", "ts", "1 day", order="event_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("rms", 6).alias("rms"), F.round("brightness", 6).alias("brightness"), F.round(F.get("chroma", F.lit(3)), 6).alias("chroma3")),
    "flux_onsets": lambda s, d: audio.onsets(frames(s, d), "user_id", "event_id", "value"),
    "recent_trail": lambda s, d: audio.recent_trail(load(s, d, "events").select("user_id", (F.col("event_id") % 700 / 100).alias("t"), F.col("event_id").alias("nth")), "user_id", most=10),
    "profile_versions": lambda s, d: audio.versions(load(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("top")), "user_id", "day", ["n", "top"]),
    "window_words": described,
    "rollup_tasks": lambda s, d: scoring.tasks_of_rollups(rollups(s, d), "f", "ctv", "u1", 8, 4).select("identifier", F.array_join("codes", ",").alias("codes"), F.round("confidence", 4).alias("confidence")),
    "open_signatures": lambda s, d: (lambda todo, hits: todo.select("signature", "n", F.lit(False).alias("cached")).unionByName(hits.select("signature", F.col("hits").alias("n"), F.lit(True).alias("cached"))))(*scoring.open_signatures(tasks(s, d), cached_scores(s, d))),
    "prewarmed_cache": lambda s, d: scoring.prewarmed(tasks(s, d), cached_scores(s, d), scoring.stub_scorer).groupBy("confidence").agg(F.count("*").alias("n"), F.sum("emotional").alias("emotional")),
    "materialised_scores": lambda s, d: _materialised(s, d)["analyses"].select("id", "identifier", "confidence", *AXES),
    "materialised_identifiers": lambda s, d: _materialised(s, d)["identifiers"].select("identifier", "observations", F.array_join("codes", ",").alias("codes")),
    "materialised_queue": lambda s, d: _materialised(s, d)["queue"].groupBy("status").agg(F.count("*").alias("n")),
    "unchanged_codes": lambda s, d: tasks(s, d).groupBy(scoring.known_codes(F.col("codes"), F.when(F.col("id") % 3 > 0, F.array(F.lit("status.f"), F.lit("status.o"), F.lit("1-urgent"), F.lit("5-low")))).alias("known")).agg(F.count("*").alias("n")),
    "scores_by_name": _by_name,
    "beacons": _beacons,
    "tag_imports": lambda s, d: beacons.metric_summary(_imports(s, d)[0]),
    "tag_import_skips": lambda s, d: _imports(s, d)[1],
    "tag_score_coverage": lambda s, d: beacons.score_coverage(_imports(s, d)[0], load(s, d, "customer").select(F.concat(F.lit("d"), (F.col("c_custkey") % 45).cast("string")).alias("device_id"), _nth("c_custkey", ("scored", "failed")).alias("status")).where("device_id <> 'd7'")),
}

_PLACE = f"(SELECT *, {nth('p_size', ('visit.brand.', 'iab.', 'POI.x.', 'web.topic.'))} || replace(lower(label), ' ', '_') AS code FROM (SELECT p_partkey, p_size, {nth('p_partkey', ('City Hospital', 'Coffee shop', 'St. Mary church', 'Food bank', 'Gym'))} AS label FROM part))"
_TREE = "(SELECT 'r' || r_regionkey AS id, r_name AS label, NULL AS parent_id FROM region WHERE r_regionkey > 0 UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer)"
_CODE = lambda c: f"{nth(c, ('iab.', 'ctv.', 'app.'))} || {c}"
_MATCH = f"""(SELECT {_CODE('q')} AS code, 'aset.' || t AS target, round(s, 4) AS similarity, t % 11 = 0 AS approved, t % 11 = 1 AS rejected FROM (SELECT a.vec_id AS q, b.vec_id AS t, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, 'aset.' || b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE a.label < 6 AND a.vec_id % 5 = 0 AND b.label >= 6) WHERE r <= 3)"""
_ITEM = "(SELECT id, parent_id, label AS title, CASE id[1] WHEN 'r' THEN 'label' WHEN 'n' THEN 'album' ELSE 'track' END AS kind, k, CASE WHEN id[1] = 'c' AND k % 3 > 0 THEN ['s' || (k % 5), 's' || (k % 7)] ELSE [] END AS symbols, CASE WHEN id[1] = 'c' AND k % 4 > 0 THEN (k % 101)::DOUBLE END AS score FROM (SELECT *, substr(id, 2)::INT AS k FROM " + _TREE + "))"
_ROLL = f"""(WITH i AS {_ITEM}, y AS (SELECT symbol, floor(avg(score) + 0.5) AS mark, count(*) AS w FROM (SELECT DISTINCT id, score, unnest(symbols) AS symbol FROM i WHERE kind = 'track' AND score IS NOT NULL) GROUP BY 1),
  u AS (SELECT t.id, t.score, t.symbols, n.id AS album, n.parent_id AS label FROM i t JOIN i n ON t.parent_id = n.id WHERE t.kind = 'track' AND t.score IS NOT NULL), b AS (SELECT album AS top, id, score, symbols FROM u UNION ALL SELECT label, id, score, symbols FROM u WHERE label <> 'r0'),
  p AS (SELECT top, count(*) AS tracks, avg(score) AS plain FROM b GROUP BY 1), w AS (SELECT top, sum(mark * w) / sum(w) AS weighed FROM (SELECT DISTINCT top, symbol FROM (SELECT top, unnest(symbols) AS symbol FROM b)) JOIN y USING (symbol) GROUP BY 1)
  SELECT id, floor(score + 0.5) AS score, CASE WHEN score IS NULL THEN 'none' ELSE 'measured' END AS basis, (score IS NOT NULL)::INT AS tracks FROM i WHERE kind = 'track'
  UNION ALL SELECT id, floor(coalesce(weighed, plain) + 0.5), CASE WHEN weighed IS NOT NULL THEN 'symbols' WHEN plain IS NOT NULL THEN 'measured' ELSE 'none' END, coalesce(tracks, 0) FROM i LEFT JOIN p ON id = p.top LEFT JOIN w ON id = w.top WHERE kind <> 'track')"""
_SRC = f"""(SELECT p_partkey, p_name AS name, provider, CASE WHEN provider IN ('ctv', 'data') THEN 'user_data' ELSE 'audio' END AS kind, CASE WHEN p_size > 40 OR {' OR '.join(f"contains(lower(p_name), '{w}')" for w in catalogue.SPOKEN)} THEN 'spoken_word' WHEN provider IN ('ctv', 'data') THEN 'mixed' WHEN provider = 'stream' THEN 'music' ELSE 'mixed' END AS content,
  CASE WHEN p_partkey % 7 = 0 THEN 'mp3' WHEN provider = 'stream' THEN 'stream' WHEN provider IN ('ctv', 'data') THEN 'signal' ELSE 'other' END AS file_type FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'stream' WHEN 1 THEN 'ctv' WHEN 2 THEN 'data' ELSE CASE WHEN p_partkey % 7 = 0 THEN 'upload' ELSE 'other' END END AS provider FROM part))"""
_UNIT = lambda x: f"greatest(0, least(1, {x}))"
_FEAT = f"""(SELECT *, {_UNIT('(centroid - 300) / 5700')} AS bright, {_UNIT('flat * 1.6')} AS noise, {_UNIT('(onset - 0.2) / 5.8')} AS busy, {_UNIT('(dynamic - 0.01) / 0.34')} AS dyn, {_UNIT('(rolloff - 1500) / 9500')} AS body, {_UNIT('(rms - 0.01) / 0.29')} AS level FROM (SELECT event_id, (event_id % 20)::DOUBLE AS duration, {_UNIT('value % 1')} AS rms, (event_id % 40) / 100 AS dynamic, greatest(0, least(192000, value * 60)) AS centroid,
  CASE WHEN event_id % 9 > 0 THEN (event_id % 70) / 100 ELSE 0 END AS flat, greatest(0, least(192000, value * 100)) AS rolloff, {_UNIT('(event_id % 13) / 12')} AS speech, {_UNIT('(event_id % 7) / 5')} AS voiced, greatest(0, (event_id % 11) - 2) AS onset, (event_id % 5) / 4 AS activity FROM events))"""
_BLEND = dict(zip(SQL_AXES, (
    "0.4 * dyn + 0.25 * level + 0.2 * voiced + 0.15 * (1 - noise)", "0.4 * speech + 0.25 * (1 - busy) + 0.2 * voiced + 0.15 * (1 - dyn)", "0.4 * busy + 0.3 * noise + 0.2 * body + 0.1 * level",
    "0.5 * speech + 0.3 * voiced + 0.2 * (1 - bright)", "0.35 * noise + 0.3 * body + 0.2 * (1 - dyn) + 0.15 * activity", "0.35 * (1 - noise) + 0.25 * busy + 0.2 * bright + 0.2 * dyn",
)))
_RMS = lambda x: f"sqrt(list_sum(list_transform({x}, lambda q: q * q)) / len({x}))"
_ABS = lambda a, b, k="": f"list_transform(embedding[{a}:{b}]::DOUBLE[], lambda q: abs(q){k})"
_MUSIC = f"""(SELECT *, {_UNIT('0.55 * clear + 0.3 * ' + _UNIT(_RMS('tonnetz') + ' * 2') + ' + 0.15 * (1 - flat)')} AS p, {_UNIT(f"0.45 * beat + 0.3 * CASE WHEN tempo IS NULL THEN 0.4 WHEN tempo BETWEEN 60 AND 180 THEN 1 ELSE {_UNIT('1 - least(abs(tempo - 120) - 60, 120) / 120')} END + 0.25 * {_UNIT('1 - abs(least(onset, 12) - 3.5) / 8.5')}")} AS r,
  {_UNIT(f"0.35 * {_UNIT('list_avg(contrast) / 40')} + 0.25 * {_UNIT(_RMS('mfcc[2:]') + ' / 40')} + 0.2 * {_UNIT('vec_id * 30.0 / 11000')} + 0.2 * {_UNIT('vec_id * 20.0 / 5000')}")} AS t, {_UNIT('0.4 * clear + 0.35 * beat + 0.25 * (1 - least((vec_id % 4) / 10 * 4, 1))')} AS heard FROM
  (SELECT *, {_UNIT('1 + list_sum(list_transform(chroma, lambda q: CASE WHEN q > 0 THEN q / total * ln(q / total) ELSE 0 END)) / ln(12)')} AS clear FROM (SELECT vec_id, embedding, {_ABS(1, 12)} AS chroma, list_sum({_ABS(1, 12)}) AS total, {_ABS(13, 18)} AS tonnetz, {_ABS(19, 25, ' * 40')} AS contrast, {_ABS(26, 38, ' * 40')} AS mfcc, (vec_id % 10) / 10 AS flat, CASE WHEN vec_id % 6 > 0 THEN vec_id % 300 END AS tempo, {_UNIT('(vec_id % 9) / 8')} AS beat, vec_id % 14 AS onset FROM embeddings)))"""
_PCT = lambda x: f"floor(round(({x}) * 100, 9) + 0.5)"
_WIN = "(SELECT user_id, ts::DATE::TIMESTAMP AS start, count(*) AS n, avg(value % 1) AS rms, avg(value * 100) AS hz, " + ", ".join(f"sum((event_id + {i * i}) % 12 / 12) / count(*) AS c{i}" for i in range(12)) + " FROM events GROUP BY 1, 2)"
_ONTO = "(SELECT o_orderkey AS i, 'sound_' || (o_orderkey % 60) AS slug, 'Sound ' || (o_orderkey % 60) AS name FROM orders WHERE o_orderkey < 200)"

ORACLE_SQL: dict[str, str] = {
    "sensitive_places": f"SELECT p_partkey, p_size % 4 IN (0, 2) AND p_partkey % 5 IN (0, 2, 3) AS sensitive, CASE p_size % 4 WHEN 0 THEN regexp_extract(code, '^(.*)\\.[^.]*$', 1) WHEN 2 THEN regexp_extract(code, '^(.*)\\.[^.]*$', 1) WHEN 3 THEN regexp_extract(code, '^(.*)\\.[^.]*$', 1) ELSE CASE WHEN len(string_split(code, '.')) > 2 THEN regexp_extract(code, '^(.*)\\.[^.]*$', 1) END END AS family FROM {_PLACE}",
    "prefix_codes": f"SELECT code, count(*) AS n FROM {_PLACE} WHERE starts_with(code, 'visit.') OR starts_with(code, 'iab.') GROUP BY 1",
    "named_tags": f"WITH p AS {_PLACE}, n AS (SELECT code, min(p_partkey) % 2 = 0 AS off FROM p WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT 'kept' AS kind, code, count(*) AS n FROM p JOIN n USING (code) WHERE NOT off GROUP BY 2 UNION ALL SELECT DISTINCT 'new', code, 1 FROM p WHERE code NOT IN (SELECT code FROM n)",
    "grounding_counts": f"WITH p AS {_PLACE} SELECT code, now AS grounding_count FROM (SELECT code, count(*) % 5 AS was, count(DISTINCT p_partkey % 40) FILTER (p_partkey % 40 % 2 = 0 AND p_partkey % 40 % 3 > 0) AS now FROM p GROUP BY 1) WHERE was <> now",
    "ontology_tree": f"""WITH RECURSIVE o AS {_ONTO}, e AS (SELECT DISTINCT a.i AS p, b.i AS c FROM o a JOIN o b ON a.i > 0 AND b.i IN (a.i * 2, a.i * 2 + 1, a.i * 3) AND a.i <> b.i), w(i, d) AS (SELECT i, 0 FROM o WHERE i NOT IN (SELECT c FROM e) UNION SELECT c, d + 1 FROM w JOIN e ON p = i),
      h AS (SELECT i, min(d) AS depth FROM w GROUP BY 1), t AS (SELECT h.i, h.depth, min(e.p::VARCHAR) AS parent FROM h LEFT JOIN e ON e.c = h.i AND e.p IN (SELECT i FROM h x WHERE x.depth = h.depth - 1) GROUP BY 1, 2),
      k AS (SELECT t.*, name, 'aset.' || slug || CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY depth, t.i::VARCHAR) > 1 THEN '__' || row_number() OVER (PARTITION BY slug ORDER BY depth, t.i::VARCHAR) ELSE '' END AS code FROM t JOIN o USING (i))
      SELECT a.i::VARCHAR AS id, a.code, a.name AS label, b.code AS parent_code, a.depth FROM k a LEFT JOIN k b ON a.parent = b.i::VARCHAR""",
    "path_nodes": "SELECT DISTINCT p_type AS id, p_type AS label, NULL AS parent_id FROM part UNION ALL SELECT DISTINCT p_type || ' > ' || p_brand, p_brand, p_type FROM part UNION ALL SELECT DISTINCT p_type || ' > ' || p_brand || ' > ' || (p_size % 5), (p_size % 5)::VARCHAR, p_type || ' > ' || p_brand FROM part",
    "tree_parents": "SELECT 'r' || r_regionkey AS id, r_regionkey = 0 AS synthesised FROM region",
    "tree_search": f"WITH t AS {_TREE}, h AS (SELECT id, parent_id FROM t WHERE contains(lower(label), 'nation_1')) SELECT id, label FROM t WHERE id IN (SELECT id FROM h UNION SELECT parent_id FROM h)",
    "subtree_sizes": "SELECT 'n' || n_nationkey AS id, 1 + count(c_custkey) AS nodes FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) > 0 UNION ALL SELECT 'r' || n_regionkey, (n_regionkey > 0)::INT + count(DISTINCT n_nationkey) + count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    "crosswalk_matches": f"SELECT * FROM {_MATCH}",
    "crosswalk_approved": f"SELECT code, target FROM {_MATCH} WHERE NOT rejected AND similarity >= 0.15 AND code NOT IN (SELECT code FROM {_MATCH} WHERE approved) QUALIFY row_number() OVER (PARTITION BY code ORDER BY similarity DESC, target) <= 1",
    "crosswalk_coverage": f"WITH c AS (SELECT {_CODE('vec_id')} AS code FROM embeddings WHERE label < 6), m AS (SELECT code, bool_or(approved) AS a FROM {_MATCH} GROUP BY 1) SELECT split_part(code, '.', 1) || '.' AS prefix, count(*) AS total, count(a) AS proposed, count(*) FILTER (a) AS approved, count(*) FILTER (a) = count(*) AS complete FROM c LEFT JOIN m USING (code) WHERE NOT starts_with(code, 'app.') GROUP BY 1",
    "originality_rollup": f"SELECT * FROM {_ROLL}",
    "label_ranking": f"""WITH i AS {_ITEM}, r AS {_ROLL}, t AS (SELECT n.parent_id AS label, count(*) AS tracks, count(*) FILTER (t.k % 2 = 0) AS linked, count(*) FILTER (t.k % 3 > 0) AS marked, count(*) FILTER (t.k % 6 > 0) AS dated,
      avg(CASE WHEN t.k % 2 = 0 THEN CASE WHEN t.k % 5 = 0 THEN 0.5 WHEN t.k % 90 > 1 THEN (t.k % 90) / 100 ELSE t.k % 90 END * CASE t.k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.35 END END) AS g FROM i t JOIN i n ON t.parent_id = n.id WHERE t.kind = 'track' GROUP BY 1),
      l AS (SELECT i.id, title, r.score AS o, least(100, g * 100) AS gr, round(0.2 * (EXISTS (SELECT 1 FROM i a WHERE a.parent_id = i.id))::INT * 100 + 0.2 * least(100, coalesce(t.tracks, 0) * 20) + 0.25 * coalesce(linked, 0) / greatest(1, coalesce(t.tracks, 0)) * 100 + 0.2 * coalesce(marked, 0) / greatest(1, coalesce(t.tracks, 0)) * 100 + 0.15 * coalesce(dated, 0) / greatest(1, coalesce(t.tracks, 0)) * 100, 9) AS c, coalesce(t.tracks, 0) AS tracks FROM i LEFT JOIN t ON i.id = t.label LEFT JOIN r ON r.id = i.id WHERE i.kind = 'label')
      SELECT id, title, floor(round(0.45 * coalesce(o, 0) + 0.35 * coalesce(gr, 0) + 0.2 * c, 9) + 0.5) AS score, o AS originality, round(gr, 4) AS grounding, floor(c + 0.5) AS completeness, tracks, CASE WHEN coalesce(o, 0) <= least(coalesce(gr, 0), c) THEN 'originality' WHEN coalesce(gr, 0) <= c THEN 'grounding' ELSE 'completeness' END AS gap FROM l""",
    "library_facets": " UNION ALL ".join(f"SELECT '{n}' AS facet, {n} AS value, count(*) AS n FROM {_SRC} GROUP BY 2" for n in ("provider", "kind", "content", "file_type")),
    "library_page": f"SELECT p_partkey, provider, file_type FROM {_SRC} WHERE kind = 'audio' ORDER BY name DESC, p_partkey LIMIT 20 OFFSET 10",
    "tag_frequencies": f"SELECT code, count(*) AS n FROM (SELECT unnest([c1, c2]) AS code FROM {T}) GROUP BY 1",
    "accented_search": "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'economy') OR contains(lower(p_type), 'economy') OR contains(lower(p_brand), 'economy')) AND (contains(lower(p_name), 'brand') OR contains(lower(p_type), 'brand') OR contains(lower(p_brand), 'brand'))",
    "feature_axes": f"SELECT event_id, {each(lambda a, i: f'floor(greatest(8, least(97, round(({_BLEND[a]}) * 100, 9))) + 0.5) AS {a}')}, {HALF_UP(_UNIT('0.65 * activity + 0.35 * ' + _UNIT('(duration - 1) / 14')), 100)} AS confidence FROM {_FEAT}",
    "spectrum_axes": f"SELECT vec_id, {each(lambda a, i: f'floor({_UNIT(f'round(list_avg({_ABS(10 * i + 1, 10 * i + 10)}), 9)')} * 100 + 0.5) AS {a}')} FROM embeddings",
    "musical_scores": f"SELECT vec_id, {_PCT('p')} AS pitch, {_PCT('r')} AS rhythm, {_PCT('t')} AS timbre, floor(round(CASE WHEN vec_id % 3 = 0 THEN {_UNIT('0.6 * (vec_id % 5) / 5 + 0.4 * heard')} ELSE heard END, 9) * 100 + 0.5) / 100 AS musicality FROM {_MUSIC}",
    "originality": f"""WITH m AS (SELECT vec_id, embedding, [{_PCT('p')} / 100, {_PCT('r')} / 100, {_PCT('t')} / 100] AS trio, floor(round(heard, 9) * 100 + 0.5) / 100 AS mus FROM {_MUSIC}),
      g AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 2 THEN 0.65 ELSE 0.3 END AS trust, CASE WHEN vec_id % 5 > 0 THEN list_transform(list_filter(embedding[40:43]::DOUBLE[], lambda q: q > 0), lambda q: least(q, 1.0)) ELSE [] END AS sims FROM m),
      h AS (SELECT *, {_UNIT('0.35 * trust + 0.65 * ' + _UNIT('(vec_id % 11) / 10'))} AS grounding, CASE WHEN len(sims) > 0 THEN {_UNIT('0.75 * (1 - list_avg(sims)) + 0.25 * CASE WHEN len(sims) > 1 THEN list_max(sims) - list_min(sims) ELSE 0 END')} ELSE 0.5 END AS tax, {_UNIT('(0.6 * ' + _UNIT('list_stddev_pop(trio) / 0.25') + ' + 0.4 * list_max(trio)) * mus + 0.5 * (1 - mus)')} AS craft FROM g)
      SELECT vec_id, {_PCT('0.3 * grounding + 0.35 * tax + 0.35 * craft')} AS originality, floor(round(0.4 * trust + 0.3 * (len(sims) > 0)::INT + 0.3 * mus, 9) * 1000 + 0.5) / 1000 AS evidence FROM h""",
    "feature_windows": f"SELECT user_id, start, n, round(rms, 6) AS rms, round(least(1, hz / 4000), 6) AS brightness, round(c3, 6) AS chroma3 FROM {_WIN}",
    "flux_onsets": "WITH f AS (SELECT user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, avg(value) OVER (PARTITION BY user_id) + stddev_pop(value) OVER (PARTITION BY user_id) AS l, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) FILTER (value > l AND value >= a AND value > b AND n > 4) AS onsets FROM f GROUP BY 1",
    "recent_trail": "WITH e AS (SELECT user_id, event_id % 700 / 100 AS t, event_id AS nth FROM events) SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.nth > a.nth AND abs(b.t - a.t) <= 0.01) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, nth DESC) <= 10",
    "profile_versions": "SELECT *, n - lag(n) OVER w AS n_change, top - lag(top) OVER w AS top_change FROM (SELECT user_id, ts::DATE AS day, count(*) AS n, max(event_id) AS top FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY day)",
    "window_words": f"""WITH a AS (SELECT *, {each(lambda a, i: f'user_id * {i + 3} % 90 AS {a}')}, [{', '.join(f'c{i}' for i in range(12))}] AS c FROM {_WIN}), t AS (SELECT user_id, start, array_to_string(list(axis ORDER BY v DESC, k)[1:2], ' and ') AS top FROM (SELECT user_id, start, unnest(['{"', '".join(SQL_AXES)}']) AS axis, unnest([{', '.join(SQL_AXES)}]) AS v, unnest(range(6)) AS k FROM a) GROUP BY 1, 2)
      SELECT user_id, start, 'A ' || CASE WHEN rms > 0.55 THEN 'loud' WHEN rms > 0.22 THEN 'moderate' ELSE 'quiet' END || ', ' || CASE WHEN hz > 3200 THEN 'very bright, sibilant' WHEN hz > 1800 THEN 'bright' WHEN hz > 900 THEN 'warm' ELSE 'dark, bass-heavy' END || ' ' || CASE WHEN communication >= 55 THEN 'speech-forward' ELSE 'music-forward' END || ' audio segment with ' || (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[list_position(c, list_max(c))] || ' as the dominant pitch class, strongest on ' || top || ' semantics.' AS said FROM a JOIN t USING (user_id, start)""",
    "rollup_tasks": "WITH r AS (SELECT 'u' || user_id AS subject, code, count(*) AS w FROM (SELECT user_id, 'type.' || event_type AS code FROM events UNION ALL SELECT user_id, 'k.' || (json_extract(props, '$.k')::INT // 10) FROM events WHERE json_extract(props, '$.k') IS NOT NULL) GROUP BY 1, 2), s AS (SELECT DISTINCT subject FROM r WHERE subject > 'u1' ORDER BY 1 LIMIT 8), t AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY w DESC, code) AS k FROM r WHERE subject IN (SELECT subject FROM s)) SELECT subject AS identifier, string_agg(code, ',' ORDER BY k) AS codes, round(least(0.9, 0.4 + 0.05 * count(*)), 4) AS confidence FROM t WHERE k <= 4 GROUP BY 1",
    "open_signatures": f"SELECT signature, count(*) AS n, signature IN (SELECT signature FROM {C}) AS cached FROM {T} WHERE status = 'pending' GROUP BY 1",
    "prewarmed_cache": f"SELECT confidence, count(*) AS n, sum(e) AS emotional FROM (SELECT 0.4 AS confidence, emotional AS e FROM {C} UNION ALL SELECT 0.5, floor(('0x' || substr(signature, 1, 2))::INT / 255 * 100 + 0.5) FROM (SELECT DISTINCT signature FROM {T} WHERE status = 'pending' AND signature NOT IN (SELECT signature FROM {C}))) GROUP BY 1",
    "materialised_scores": f"SELECT id, identifier, confidence, {', '.join(SQL_AXES)} FROM {T} t JOIN {C} c ON t.signature = c.signature WHERE status = 'pending'",
    "materialised_identifiers": f"WITH d AS (SELECT t.* FROM {T} t JOIN {C} c ON t.signature = c.signature WHERE status = 'pending'), b AS (SELECT DISTINCT identifier, 2 AS n, unnest(['old', 'status.f']) AS code FROM {T} WHERE identifier % 4 = 0 UNION ALL SELECT identifier, 0, unnest([c1, c2]) FROM d), o AS (SELECT identifier, sum(n) AS n FROM (SELECT DISTINCT identifier, 2 AS n FROM {T} WHERE identifier % 4 = 0 UNION ALL SELECT identifier, count(*) FROM d GROUP BY 1) GROUP BY 1) SELECT identifier, any_value(o.n)::BIGINT AS observations, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM b JOIN o USING (identifier) GROUP BY 1",
    "materialised_queue": f"SELECT CASE WHEN status = 'pending' AND signature IN (SELECT signature FROM {C}) THEN 'done' ELSE status END AS status, count(*) AS n FROM {T} GROUP BY 1",
    "unchanged_codes": f"SELECT id % 3 > 0 AND c1 IN ('1-urgent', '5-low') AND c2 IN ('status.f', 'status.o') AS known, count(*) AS n FROM {T} GROUP BY 1",
    "scores_by_name": f"WITH c AS (SELECT c_custkey % 40 AS k, max(c_custkey) AS m FROM customer GROUP BY 1) SELECT o_orderkey AS record_id, {each(lambda a, i: f'CASE WHEN k < 30 THEN (m * {i + 2} % 97)::DOUBLE END AS {a}')}, CASE WHEN k < 15 THEN 0.7 WHEN k < 30 THEN 0.5 END AS confidence, CASE WHEN k < 15 THEN 'analysis' WHEN k < 30 THEN 'cache' END AS basis FROM orders LEFT JOIN c ON k = o_custkey % 40",
    "beacons": """WITH b AS (SELECT page_id, CASE WHEN page_id % 13 > 0 THEN page_id % 4 END AS t, CASE WHEN page_id % 3 > 0 THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS h, page_id % 3 AS m, page_id % 4 AS v, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages)
      SELECT page_id, CASE WHEN t IS NULL THEN 'no tag' WHEN t > 1 THEN 'unknown or inactive tag' WHEN t = 1 AND h IS NOT NULL AND NOT regexp_full_match(h, '(.*\\.)?example\\.(com|net)') THEN 'origin not allowed' WHEN m = 2 THEN 'unknown metric' WHEN v = 2 THEN 'value is no number' END AS problem, CASE v WHEN 0 THEN 1.5 WHEN 3 THEN 7.0 END AS number, utm_source FROM b""",
    "tag_imports": "SELECT lower(o_orderstatus) AS metric, count(*) AS events, count(DISTINCT o_custkey % 30) AS devices, round(avg(o_totalprice), 3) AS avg_value FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 10 > 0 GROUP BY 1",
    "tag_import_skips": "SELECT o_orderkey AS row, CASE WHEN o_orderkey % 9 = 0 THEN 'value is not a number' ELSE 'occurred_at is not a date' END AS reason FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0",
    "tag_score_coverage": "WITH d AS (SELECT DISTINCT o_custkey % 30 AS k FROM orders WHERE o_orderkey % 9 > 0 AND o_orderkey % 10 > 0), c AS (SELECT c_custkey % 45 AS k, count(*) FILTER (c_custkey % 2 = 0) AS s FROM customer WHERE c_custkey % 45 <> 7 GROUP BY 1) SELECT count(*) AS devices, count(s) AS matched, sum(s)::BIGINT AS scored FROM d LEFT JOIN c USING (k)",
}
