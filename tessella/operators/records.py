"""Insight into JSON records of any shape: what signals they carry, and which way those tilt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S

AXES = list(S.AXES)
#: Where an envelope holds its rows, first come first served.
COLLECTIONS = ("items", "rows", "results", "records", "values", "list")
#: The kind of signal of a field's name.
FIELDS = (
    ("^(contentgenre|content_genre|genre|genrename|genres)$", "genre"),
    ("^(contenttype|content_type|programtype)$", "content-type"),
    ("^(channelname|channel_name|channel|network|networkname|publisher)$", "channel"),
    ("^(appname|app_name|bundle_?id|app_?id|categoryname|category_name|category|taxonomyname|taxonomy_name|taxonomy)$", "app"),
    ("^(iab_?cats?|iab_categories|iab|iabcategory)$", "iab"),
    ("^(brand_?name|brand|poi_?name|chain)$", "brand"),
    ("^(daypart|day_part|hour|dow|weekday)$", "daypart"),
    ("^(country|state|region|dma|metro|city|zip|postal_?code)$", "geo"),
    ("^(device_?id|devicetype|ctv_?taxonomy|platform|os|make|model|useragent)$", "device"),
    ("^(audience_?name|audience|activation_?name|activation_?id|audience_?id|cohort|segment|segment_?codes)$", "audience"),
)
#: What a signal's label does to the axes.
TILTS = (
    ("music|audio|song|radio", {"artistic": 8, "emotional": 6, "communication": -4}),
    ("news|talk|podcast|spoken|speech|audiobook", {"communication": 10, "cognitive": 6, "artistic": -6}),
    ("sport|live|event", {"social": 8, "emotional": 4, "cognitive": -3}),
    ("kids|family|comedy", {"social": 6, "emotional": 5}),
    ("documentar|education|learn|business|finance|tech", {"cognitive": 9, "contextual": 4, "emotional": -4}),
    ("drama|movie|film|series", {"emotional": 7, "artistic": 5}),
    ("travel|local|visit|store|retail|auto|restaurant", {"contextual": 9, "social": 3}),
    ("morning|daytime|primetime|overnight|late ?night|evening", {"contextual": 5}),
)
#: Parts of a value that count, the longest label, and the most that one signal weighs.
MOST_PARTS, LONGEST, HEAVIEST = 8, 48, 3.0


def _object(v: Column) -> Column:
    """The fields of a variant that is an object, else null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(v: Column) -> Column:
    """A scalar as trimmed text, an array's elements joined; empty for nulls and objects."""
    of = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null"))
    plain = F.when(_object(v).isNull(), F.try_variant_get(v, "$", "string"))
    return F.trim(_let(_list(v), lambda many: F.coalesce(F.when(many.isNotNull(), F.array_join(F.transform(many, of), " | ")).otherwise(plain), F.lit(""))))


def with_records(df: DataFrame, payload: str, name: str) -> DataFrame:
    """``df`` with the records of a JSON text, as an array of variants: the objects of the array that
    it or its ``data`` is or has under one of ``COLLECTIONS``, else that object itself; none for
    other texts. Texts are parsed once."""
    inner = lambda v: F.try_variant_get(v, "$.data", "variant")
    parsed = df.withColumn("__v", F.try_parse_json(payload))
    parsed = parsed.withColumn("__v", _let(inner(F.col("__v")), lambda x: F.when(x.isNotNull() & ~F.is_variant_null(x), x).otherwise(F.col("__v"))))
    found = F.coalesce(_list(F.col("__v")), *[_list(F.col("__v"), f"$.{c}") for c in COLLECTIONS], F.array("__v"))
    return parsed.withColumn(name, F.filter(found, lambda x: _object(x).isNotNull())).drop("__v")


def _deeper(fields: Column) -> Column:
    """Fields (``name, value``) with each object replaced by its fields, under dotted names."""
    own = lambda f: F.array(F.struct(f["name"].alias("name"), f["value"].alias("value")))
    inside = lambda f, m: F.transform(F.map_entries(m), lambda e: F.struct(F.concat(f["name"], F.lit("."), e["key"]).alias("name"), e["value"].alias("value")))
    return F.flatten(F.transform(fields, lambda f: _let(_object(f["value"]), lambda m: F.when(m.isNotNull(), inside(f, m)).otherwise(own(f)))))


def flattened(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """``key, record, name, text``: every field of every record, those of objects down to the third
    level under dotted names, as text; empty ones and deeper objects are left out."""
    return _told(_fields(df, key, payload))


def _fields(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, record, name, value`` of every field. Outer generators, as Spark puts the generated
    array of others into a filter before them and works it out again for that."""
    rows = with_records(df.select(key, payload), payload, "__rows").select(key, F.posexplode_outer("__rows").alias("record", "row"))
    top = F.transform(F.map_entries(_object(F.col("row"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    rows = rows.select(key, "record", F.explode_outer(_deeper(_deeper(top))).alias("f"))
    return rows.where("f is not null").select(key, "record", F.col("f")["name"].alias("name"), F.col("f")["value"].alias("value"))


def _told(fields: DataFrame) -> DataFrame:
    """``fields`` with ``text`` for ``value``, without empty ones. Each text is worked out once."""
    told = fields.withColumn("text", F.explode_outer(F.array(_text(F.col("value")))))
    return told.where("text <> ''").drop("value")


def _kind(name: Column, fields: Sequence[tuple[str, str]]) -> Column:
    leaf = F.element_at(F.split(name, r"\."), -1)
    return F.coalesce(*[F.when(leaf.rlike(f"(?i){pattern}"), kind) for pattern, kind in fields])


def signals(df: DataFrame, key: str, payload: str = "payload", fields: Sequence[tuple[str, str]] = FIELDS) -> DataFrame:
    """``key, kind, label, n``: how often each signal occurs in the key's records, in whatever case;
    the label is the least of its spellings. Values are cut at ``| , ;``, and the first
    ``MOST_PARTS`` parts of up to ``LONGEST`` characters count."""
    rows = flattened(df, key, payload).withColumn("kind", _kind(F.col("name"), fields)).where("kind is not null")
    parts = F.slice(F.filter(F.transform(F.split("text", "[|,;]"), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_PARTS)
    told = rows.select(key, "kind", F.explode(parts).alias("label")).where(F.char_length("label") <= LONGEST)
    return told.groupBy(key, "kind", F.lower("label").alias("__l")).agg(F.min("label").alias("label"), F.count("*").alias("n")).drop("__l")


def insights(df: DataFrame, key: str, payload: str = "payload", fields: Sequence[tuple[str, str]] = FIELDS, tilts: Sequence[tuple[str, dict]] = TILTS) -> DataFrame:
    """``key, records, signals, matched, unmapped``, the axes' preview scores around 50 and
    ``<axis>_tilt``: each signal moves them by the rules that fit its label, by its weight, over
    half the number of signals that any rule fits. ``unmapped`` counts those that none does,
    audiences aside. A key whose text is no JSON or has no record has zeros and 50s."""
    per = with_records(df.select(key, payload), payload, "__rows").groupBy(key).agg(F.sum(F.size("__rows")).alias("records"))
    own = signals(df, key, payload, fields)
    fits = [F.col("label").rlike(f"(?i){p}") for p, _ in tilts]
    hit = F.greatest(*[f.cast("int") for f in fits]) if len(fits) > 1 else fits[0].cast("int")
    weight = F.least(F.lit(HEAVIEST), F.log10(F.col("n") + 1) + 1)
    moves = {a: sum((F.when(f, weight * t[a]).otherwise(0.0) for f, (_, t) in zip(fits, tilts) if a in t), F.lit(0.0)) for a in AXES}
    sums = own.groupBy(key).agg(
        F.count("*").alias("signals"), F.sum(hit).alias("matched"), F.count_if((hit == 0) & (F.col("kind") != "audience")).alias("unmapped"), *[F.sum(m).alias(f"__{a}") for a, m in moves.items()],
    )
    joined = per.withColumnRenamed(key, "__key").join(sums, F.col("__key").eqNullSafe(F.col(key)), "left")
    half = F.greatest(F.lit(1.0), F.coalesce("matched", F.lit(0)) / 2)
    # Sums differ in their last digits by their order.
    tilt = {a: F.round(F.coalesce(f"__{a}", F.lit(0.0)) / half, 9) for a in AXES}
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        F.col("__key").alias(key), zero("records"), zero("signals"), zero("matched"), zero("unmapped"), *[S.clamp(S.half_up(50 + t), 0.0, 100.0).alias(a) for a, t in tilt.items()], *[S.half_up(t, 1).alias(f"{a}_tilt") for a, t in tilt.items()],
    )
