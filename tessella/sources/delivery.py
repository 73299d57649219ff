"""Readers of delivery files: formats, column aliases and what object keys tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What stands for a missing value in delivered text.
BLANKS = ("", "nan", "none", "null")


def read_delivery(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Rows of ``parquet``, ``csv`` (with header), ``json`` or ``orc`` files under ``path``,
    gzip included, with ``object_key``, the file each came from.

    CSV fields may be quoted, with doubled quotes and line ends inside. ``json`` has a
    document a line, ``json_array`` files are one array of documents or an object whose
    ``rows`` is one; each such file is read by one task. Give a ``schema`` for text formats:
    without one, CSV columns are strings and JSON is read twice.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if kind == "csv":
        reader = reader.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
    elif kind not in ("parquet", "json", "json_array", "orc"):
        raise ValueError(f"unknown kind of file: {kind}")
    if kind != "json_array":
        reader = reader if schema is None else reader.schema(schema)
        return reader.format(kind).load(path).withColumn("object_key", F.col("_metadata.file_path"))
    found = reader.option("multiLine", "true").format("json").load(path) if schema is None else None
    wrapped = found is not None and found.columns == ["rows"]
    if schema is not None:
        inner = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>" if ":" in schema else None
        inner = inner or StructType.fromDDL(schema).simpleString()
        text = reader.option("wholetext", "true").format("text").load(path).withColumn("object_key", F.col("_metadata.file_path"))
        body = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.rows"))
        return text.select(F.explode(F.from_json(body, f"array<{inner}>")).alias("r"), "object_key").select("r.*", "object_key")
    found = found.withColumn("object_key", F.col("_metadata.file_path"))
    return found.select(F.explode("rows").alias("r"), "object_key").select("r.*", "object_key") if wrapped else found


#: Kinds of reports, and the words of file names that tell them.
REPORT_TYPES = ("ctv", "apps", "visitation", "demographics", "origin")
TYPE_WORDS = {
    "ctv": ("ctv", "connectedtv", "connected-tv", "streaming", "soundtracksignals", "web", "webreport", "iab", "domains"),
    "apps": ("apps", "app", "appaffinity", "mobileapp", "appusage"),
    "visitation": ("visitation", "visits", "visit", "footfall", "poi"),
    "demographics": ("demographics", "demographic", "demos", "audienceprofile", "audience", "marketingaudience", "maids", "hems", "uniquedevices"),
    "origin": ("origin", "origins", "homeorigin", "geoorigin", "travel"),
}
#: Extensions of audio files.
AUDIO_EXTENSIONS = ("mp3", "wav", "m4a", "aac", "flac", "ogg", "oga", "opus", "wma", "aiff", "aif")


def report_type(key: Column | str) -> Column:
    """The kind of report of an object key; null for none.

    A folder of that name wins, then the earliest word of the file name that tells a kind,
    then, in names without separators, the earliest of the longer words.
    """
    low = F.lower(F.col(key) if isinstance(key, str) else key)
    folder = F.coalesce(*[F.when(low.startswith(f"{t}/") | F.contains(low, F.lit(f"/{t}/")), t) for t in REPORT_TYPES])
    name = F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[a-z0-9]+$", "")
    words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: w != "")
    at = lambda ws: F.array_min(F.filter(F.array(*[F.array_position(words, w) for w in ws]), lambda i: i > 0))
    squashed = F.array_join(words, "")
    inside = lambda ws: F.array_min(F.filter(F.array(*[F.instr(squashed, w) for w in ws if len(w) > 3]), lambda i: i > 0))

    def first(place) -> Column:
        # Ties go to the kind listed first; null places sort last.
        found = F.array(*[F.when(place(ws).isNotNull(), F.struct(place(ws).cast("int").alias("at"), F.lit(i).alias("nth"), F.lit(t).alias("type"))) for i, (t, ws) in enumerate(TYPE_WORDS.items())])
        return F.array_min(F.array_compact(found))["type"]

    return F.coalesce(folder, first(at), first(inside))


def is_audio_key(key: Column | str) -> Column:
    return F.lower(F.col(key) if isinstance(key, str) else key).rlike(rf"\.({'|'.join(AUDIO_EXTENSIONS)})$")


def is_manifest_key(key: Column | str) -> Column:
    """Lists of keys, which hold no rows."""
    return (F.col(key) if isinstance(key, str) else key).rlike(r"(?i)(manifest|_keys|filelist)[^/]*\.(json|txt|csv)$")


def list_objects(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ("",), most: int | None = None) -> DataFrame:
    """``object_key, bytes, modified, report_type`` of the files under ``root`` whose key, below
    it, begins with one of ``prefixes``; each once, in the order of keys, ``most`` at most.
    Manifests are left out."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length", "modificationTime")
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    key = F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 1, F.lit(1 << 30))
    out = files.select(key.alias("object_key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(~is_manifest_key("object_key"))
    if "" not in prefixes:
        wanted = F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("object_key").startswith(p if p.endswith("/") else f"{p}/")
        out = out.where(wanted)
    out = out.withColumn("report_type", report_type("object_key")).orderBy("object_key")
    return out if most is None else out.limit(most)


def pick(df: DataFrame, *aliases: str) -> Column:
    """The first of the present columns, in any case, whose value isn't blank; null without one."""
    present = {c.lower(): c for c in df.columns}
    found = [F.trim(F.col(f"`{present[a.lower()]}`").cast("string")) for a in aliases if a.lower() in present]
    told = [F.when(~F.lower(c).isin(*BLANKS), c) for c in found]
    return F.coalesce(*told) if told else F.lit(None).cast("string")


def partition_date(key: Column | str) -> Column:
    """The date of ``dt=YYYY-MM-DD``, else the first ISO date in the key, else null."""
    text = F.col(key) if isinstance(key, str) else key
    named = F.regexp_extract(text, r"dt=(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_date(F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), "yyyy-MM-dd")


def activation_id(key: Column | str) -> Column:
    """The number after ``activation``, ``activation_id`` or ``activation-id``; null without one."""
    text = F.col(key) if isinstance(key, str) else key
    return F.nullif(F.regexp_extract(F.lower(text), r"activation[_-]?id(\d+)", 1), F.lit(""))
