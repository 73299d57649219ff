"""Delivery rows to tags: one mapper for each kind of report, and the fold per identifier.

A mapper is a select of ``identifier, label, tags, signals, confidence``: ``tags`` are
``(code, label, parent_code, weight)``, ``signals`` one JSON object. Rows without an
identifier or without a tag are left out. Columns are found under any of their aliases, in
any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.sources.delivery import pick

#: Columns that hold the identifier, in order of preference.
IDENTIFIERS = ("primary_identifier", "primaryidentifier", "eid", "maid", "madid", "maid_id", "idfa", "aaid", "gaid", "hem", "device_id", "email1", "hashed_email", "email")
#: Columns that hold a row's day.
DAYS = ("date", "event_date", "day", "dt", "timestamp", "event_time")
#: Groups of columns that a kind of report should have.
ALIASES = {
    "ctv": {"genre": ("contentgenre", "content_genre", "genre"), "content type": ("contenttype", "content_type"), "channel": ("channelname", "channel_name", "network", "domain", "site"), "IAB categories": ("iab_cats", "iab_categories", "iabcats", "iab_codes", "iabcodes")},
    "web": {"domain": ("domain", "site", "channelname", "channel_name", "network"), "page path": ("page", "path", "url"), "IAB categories": ("iab_codes", "iabcodes", "iab_cats", "iab_categories", "iabcats"), "referrer": ("ref", "referrer", "referer")},
    "apps": {"category": ("categoryname", "category_name", "category"), "taxonomy": ("taxonomyname", "taxonomy_name", "taxonomy"), "signal intensity": ("signals", "signal_count")},
    "visitation": {"brand": ("brandname", "brand_name", "brand"), "visit timestamp": ("d_utc", "timestamp", "visit_time"), "distance": ("distance", "dist_m")},
    "demographics": {"age band": ("age_range", "agerange", "age_band", "age"), "income band": ("income_range", "income_band", "income"), "household": ("household_composition", "household", "family_status", "marital_status")},
    "origin": {"origin class": ("origin_type", "location_type", "place_type", "type"), "region": ("state", "region", "dma", "metro", "city"), "travel context": ("travel_type", "travel", "distance_band")},
}
#: Columns that tell where a row is from and never become a tag.
PROVENANCE = (*IDENTIFIERS, "deviceid", "ip", "country", "provider", "day", "date", "date_utc", "dt", "year", "month", "useragent", "user_agent", "ctv_taxonomy", "bundle_id", "bundleid", "app_id", "platform", "os", "poi_id", "poiid", "location_id", "segment_codes", "segments", "visits", "impressions", "signals", "signal_count", "observation_count", "last_seen", "last_seen_at", "first_seen", "timestamp", "d_utc")

_TAG = "struct<code:string,label:string,parent_code:string,weight:int>"


def identifier_of(df: DataFrame) -> Column:
    """The join key: the first identifier that is not blank."""
    return pick(df, *IDENTIFIERS)


def row_day(df: DataFrame) -> Column:
    """The ISO date that a day column begins with; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(pick(df, *DAYS), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def _tag(family: str, value: Column, said: str, code: Column | None = None) -> Column:
    """A tag of a value; null for none."""
    made = F.struct(F.concat(F.lit(f"{family}."), S.slug(value) if code is None else code).alias("code"), F.concat(F.lit(f"{said}: "), value).alias("label"), F.lit(family).alias("parent_code"), F.lit(1).alias("weight"))
    return F.when(value.isNotNull() & (value != ""), made)


def _tags(family: str, values: Column, said: str | None) -> Column:
    label = (lambda v: F.concat(F.lit(f"{said}: "), v)) if said else iab_label
    make = lambda v: F.struct(F.concat(F.lit(f"{family}."), S.slug(v)).alias("code"), label(v).alias("label"), F.lit(family).alias("parent_code"), F.lit(1).alias("weight"))
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), make)


def iab_code(raw: Column) -> Column:
    """Upper case, only A-Z, 0-9 and dashes, and no dash after IAB."""
    return F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z0-9-]", ""), "^IAB-([0-9])", "IAB$1")


def iab_label(raw: Column, first: Column | None = None, second: Column | None = None) -> Column:
    """A label of an IAB code from maps of the first and second tier's names; without them, or
    for a code whose first tier they lack, ``IAB category`` and the raw value."""
    plain = F.concat(F.lit("IAB category "), raw)
    if first is None:
        return plain
    code = iab_code(raw)
    top = first[F.regexp_extract(code, "^(IAB[0-9]+)", 1)]
    leaf = None if second is None else F.coalesce(second[code], second[F.array_join(F.slice(F.split(code, "-"), 1, 2), "-")])
    full = F.concat_ws(" - ", code, top) if leaf is None else F.concat_ws(": ", F.concat_ws(" - ", code, top), leaf)
    return F.when(top.isNotNull(), full).otherwise(plain)


def _joined(*parts: Column, default: str) -> Column:
    some = F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), " · ")
    return F.when(some == "", default).otherwise(some)


def _boosted(raw: Column) -> Column:
    return F.coalesce(S.intensity_confidence(_count(raw), 0.7), F.lit(0.7))


def _count(raw: Column) -> Column:
    """The number that boosts a row's confidence; null for any other."""
    n = raw.try_cast("double")
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), n)


def normalise_rows(df: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``identifier, label, tags, signals, confidence`` of the rows of a report of one kind, and
    the columns to ``keep``, such as their order.

    ``signals`` is a JSON object with the fields of the kind, all of them in every row: missing
    texts are empty, missing lists too, and missing numbers null; ``meta`` holds what makes no tag.
    """
    p = lambda *names: pick(df, *names)
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    none = F.array().cast("array<string>")
    confidence = F.lit(0.7)
    if kind in ("ctv", "web"):
        groups = ALIASES["ctv"]
        genre, content, channel = p(*groups["genre"]), p(*groups["content type"]), p(*groups["channel"])
        iab, page = S.multi_values(p(*groups["IAB categories"])), p("page", "path", "url")
        topics = F.coalesce(S.path_topics(page), F.array().cast("array<string>"))
        host = S.host_of(F.coalesce(p("ref", "referrer", "referer"), F.lit("")))
        intensity = p("signals", "signal_count", "impressions")
        confidence = _boosted(intensity)
        one = F.array(_tag("ctv.genre", genre, "CTV genre"), _tag("ctv.type", content, "CTV content type"), _tag("ctv.channel", channel, "CTV channel"))
        tags = F.concat(F.array_compact(one), _tags("iab", iab, None), _tags("web.topic", topics, "Web topic"), F.array_compact(F.array(_tag("web.referrer", host, "Referrer"))))
        meta = F.struct(text(p("ctv_taxonomy", "device_id", "deviceid"), "device_id"), text(p("useragent", "user_agent"), "useragent"), text(page, "page"))
        signals = [text(genre, "contentgenre"), text(content, "contenttype"), text(channel, "channelname"), F.coalesce(iab, none).alias("iab_cats"), topics.alias("web_topics"), F.nullif(host, F.lit("")).alias("referrer_host"), _count(intensity).alias("signals"), meta.alias("meta")]
        label = _joined(channel, genre, content, F.get(topics, F.lit(0)), default="CTV impression")
    elif kind == "apps":
        groups = ALIASES[kind]
        category, taxonomy = p(*groups["category"]), p(*groups["taxonomy"])
        intensity = p("signals", "signal_count")
        confidence = _boosted(intensity)
        tags = F.array_compact(F.array(_tag("app.category", category, "App category"), _tag("app.taxonomy", taxonomy, "App taxonomy")))
        meta = F.struct(text(p("bundle_id", "bundleid", "app_id"), "bundle_id"), text(p("platform", "os"), "platform"))
        signals = [text(category, "CategoryName"), text(taxonomy, "TaxonomyName"), _count(intensity).alias("Signals"), meta.alias("meta")]
        label = _joined(category, taxonomy, default="App affinity")
    elif kind == "visitation":
        groups = ALIASES[kind]
        brand, at = p(*groups["brand"]), p(*groups["visit timestamp"])
        part = S.daypart_of_text(F.coalesce(at, F.lit("")))
        far = p(*groups["distance"]).try_cast("double")
        usable = ~F.isnan(far) & (F.abs(far) < float("inf"))
        band = F.when(far <= 25, 0.9).when(far <= 100, 0.7).when(far <= 250, 0.5).otherwise(0.35)
        confidence = F.when(usable, band).otherwise(0.7)
        tags = F.array_compact(F.array(_tag("visit.brand", brand, "Visited brand"), _tag("visit.daypart", part, "Visit daypart", part)))
        meta = F.struct(text(p("poi_id", "poiid", "location_id"), "poi_id"))
        signals = [text(brand, "brandName"), text(at, "visited_at"), part.alias("daypart"), F.when(usable, far).alias("distance"), meta.alias("meta")]
        label = _joined(brand, part, default="Visitation")
    elif kind == "demographics":
        groups = ALIASES[kind]
        age, income, household = (p(*groups[g]) for g in ("age band", "income band", "household"))
        tags = F.array_compact(F.array(_tag("demo.age", age, "Age band"), _tag("demo.income", income, "Income band"), _tag("demo.household", household, "Household")))
        meta = F.struct(F.coalesce(S.multi_values(p("segment_codes", "segments")), none).alias("segment_codes"))
        signals = [text(age, "age_band"), text(income, "income_band"), text(household, "household"), meta.alias("meta")]
        label = _joined(age, income, default="Demographics")
    elif kind == "origin":
        groups = ALIASES[kind]
        place, region, travel = (p(*groups[g]) for g in ("origin class", "region", "travel context"))
        tags = F.array_compact(F.array(_tag("origin.class", place, "Origin class"), _tag("origin.region", region, "Origin region"), _tag("origin.travel", travel, "Travel context")))
        meta = F.struct(text(p("country"), "country"), text(p("provider"), "provider"))
        signals = [text(place, "origin_class"), text(region, "region"), text(travel, "travel"), meta.alias("meta")]
        label = _joined(region, place, default="Origin")
    else:
        raise ValueError(f"unknown kind of report: {kind}")
    out = df.select(identifier_of(df).alias("identifier"), label.alias("label"), tags.cast(f"array<{_TAG}>").alias("tags"), F.to_json(F.struct(*signals), {"ignoreNullFields": "false"}).alias("signals"), F.bround(confidence, 3).alias("confidence"), *keep)
    return out.where(F.col("identifier").isNotNull() & (F.size("tags") > 0))


def merge_by_identifier(rows: DataFrame, order: Column | str, most_tags: int = 64, most_signals: int = 200) -> DataFrame:
    """One row for each identifier: tags distinct by code in the order of arrival, up to
    ``most_tags``; signals up to ``most_signals``; the highest confidence and the first label
    that is not empty. ``order`` tells the arrival.

    Tags are made distinct, and both lists cut by rank, before rows meet, so a hot identifier
    brings no more than the limits to one task.
    """
    nth = F.col(order) if isinstance(order, str) else order
    base = rows.withColumn("__nth", nth)
    tags = base.select("identifier", "__nth", F.posexplode("tags").alias("pos", "tag")).groupBy("identifier", "tag.code").agg(F.min(F.struct("__nth", "pos", "tag")).alias("t"))
    place = F.row_number().over(Window.partitionBy("identifier").orderBy("t.__nth", "t.pos"))
    tags = tags.withColumn("r", place).where(F.col("r") <= most_tags).groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("r", "t.tag"))).alias("t"))
    place = F.row_number().over(Window.partitionBy("identifier").orderBy("__nth", "signals"))
    signals = base.select("identifier", "__nth", "signals").withColumn("r", place).where(F.col("r") <= most_signals)
    signals = signals.groupBy("identifier").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "signals"))), lambda x: x["signals"]).alias("signals"))
    rest = base.groupBy("identifier").agg(F.max("confidence").alias("confidence"), F.min(F.when(F.col("label") != "", F.struct("__nth", "label")))["label"].alias("label"))
    out = rest.join(tags, "identifier").join(signals, "identifier")
    return out.select("identifier", "label", F.transform("t", lambda x: x["tag"]).alias("tags"), "signals", "confidence")


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows fit to be queued: identifiers of 1 to 512 characters, trimmed; codes trimmed and cut
    to 200, tags without one left out and 64 at most, labels cut to 300, weights 1 where 0 or
    missing, 200 signals at most, confidence from 0 to 1 and 0.5 where 0 or missing."""
    identifier = F.trim("identifier")
    tags = F.transform("tags", lambda t: F.struct(F.substring(F.trim(t["code"]), 1, 200).alias("code"), F.substring(t["label"], 1, 300).alias("label"), F.substring(t["parent_code"], 1, 200).alias("parent_code"), F.when(t["weight"] != 0, t["weight"]).otherwise(1).alias("weight")))
    told = F.filter(tags, lambda t: F.coalesce(t["code"], F.lit("")) != "")
    confidence = S.clamp(F.when(F.col("confidence") != 0, F.col("confidence")).otherwise(0.5), 0.0, 1.0)
    out = rows.select(identifier.alias("identifier"), F.substring("label", 1, 300).alias("label"), F.slice(F.coalesce(told, F.array().cast(f"array<{_TAG}>")), 1, 64).alias("tags"), F.slice("signals", 1, 200).alias("signals"), confidence.alias("confidence"))
    return out.where((F.col("identifier") != "") & (F.length("identifier") <= 512))


def is_summary_row(df: DataFrame) -> Column:
    """A taxonomy without an identifier: a summary of an audience."""
    told = F.coalesce(pick(df, *ALIASES["apps"]["taxonomy"]), pick(df, *ALIASES["apps"]["category"]))
    return identifier_of(df).isNull() & told.isNotNull()


def is_roster_row(df: DataFrame) -> Column:
    """An identifier without any content."""
    told = F.coalesce(pick(df, *ALIASES["apps"]["taxonomy"]), pick(df, *ALIASES["apps"]["category"]), pick(df, "contentgenre", "content_genre", "genre", "channelname", "iab_cats"))
    return identifier_of(df).isNotNull() & told.isNull()


def summary_rows(df: DataFrame, activation: Column) -> DataFrame:
    """The rows of summary reports as rows of one synthetic identifier for each activation,
    with ``share`` of its unique devices and a confidence of half of that above one half."""
    category, taxonomy = pick(df, *ALIASES["apps"]["category"]), pick(df, *ALIASES["apps"]["taxonomy"])
    uniques = F.coalesce(pick(df, "uniques", "unique_devices", "devices").try_cast("double"), F.lit(0.0))
    base = df.select(F.coalesce(activation, F.lit("unknown")).alias("activation"), category.alias("category"), taxonomy.alias("taxonomy"), uniques.alias("uniques"))
    totals = base.groupBy("activation").agg(F.sum("uniques").alias("sum"), F.count("*").alias("rows"))
    total = F.when(F.col("sum") != 0, F.col("sum")).otherwise(F.col("rows"))
    share = F.when(F.col("uniques") != 0, F.col("uniques")).otherwise(1.0) / total
    tags = F.array_compact(F.array(_tag("app.category", F.col("category"), "App category"), _tag("app.taxonomy", F.col("taxonomy"), "App taxonomy")))
    out = base.join(totals, "activation").where("category is not null or taxonomy is not null")
    label = F.when(F.col("category").isNull() & F.col("taxonomy").isNull(), F.concat(F.lit("Activation "), "activation")).otherwise(_joined(F.col("taxonomy"), F.col("category"), default=""))
    return out.select(F.concat(F.lit("activation:"), "activation").alias("identifier"), label.alias("label"), tags.alias("tags"), share.alias("share"), F.least(F.lit(1.0), 0.5 + 0.5 * share).alias("confidence"))


def alias_coverage(columns: list[str], kind: str) -> tuple[list[str], list[str], list[str]]:
    """Groups that a delivery's columns meet, groups that they miss, and columns that neither a
    group nor the provenance knows."""
    low = {c.lower() for c in columns}
    met = [g for g, names in ALIASES[kind].items() if low & set(names)]
    known = {n for names in ALIASES[kind].values() for n in names} | set(PROVENANCE)
    return met, [g for g in ALIASES[kind] if g not in met], [c for c in columns if c.lower() not in known]


def is_web_shaped(columns: list[str]) -> bool:
    """A report of kind ctv whose columns are those of a web report."""
    low = {c.lower() for c in columns}
    return len(low & {"domain", "page", "ref", "iab_codes", "iabcodes"}) >= 2 and not low & {"contentgenre", "content_genre", "contenttype", "content_type", "channelname"}


def inspected(df: DataFrame, kind: str, *keep: str) -> DataFrame:
    """``keep..., field, column, value``: for each field of a kind of report the column whose value a
    mapper takes, and that value; nulls where a row has none."""
    present = {c.lower(): c for c in df.columns}
    fields = []
    for field, names in {"identifier": IDENTIFIERS, **ALIASES[kind]}.items():
        found = [(present[n], pick(df, n)) for n in names if n in present]
        column = F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for c, v in found], F.lit(None).cast("string"))
        fields.append(F.struct(F.lit(field).alias("field"), column.alias("column"), pick(df, *names).alias("value")))
    return df.select(*keep, F.explode(F.array(*fields)).alias("f")).select(*keep, "f.*")
