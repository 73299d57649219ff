"""Checks of what was delivered: rows per key, and the contract of customers' CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import AXES, clamp
from tessella.sources.normalise import alias_coverage, identifier_of, is_web_shaped, normalise_rows


def rows_per_key(df: DataFrame, key: str, expected: float | None = None) -> DataFrame:
    """One row: ``rows, keys, least, median, mean, most`` of the rows of each key that is not null
    or empty, and ``drifted``: whether the median is over a quarter away from ``expected``."""
    counts = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))
    # The numbers of rows are few: count keys for each, then rank these.
    sizes = counts.groupBy("n").agg(F.count("*").alias("k"))
    out = sizes.agg(
        F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).alias("rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys"), F.min("n").alias("least"),
        F.percentile("n", 0.5, F.col("k")).alias("median"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), F.max("n").alias("most"),
    )
    drifted = F.abs(F.col("median") - expected) / expected > 0.25 if expected else F.lit(None).cast("boolean")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("drifted", drifted)


def header(name: str) -> str:
    return "_".join(name.strip().lower().split())


def number(c: Column) -> Column:
    """A number that may carry percent and dollar signs and commas; null for anything else."""
    return F.regexp_replace(F.trim(c), "[%$,]", "").try_cast("double")


def contract_rows(df: DataFrame) -> DataFrame:
    """Rows of a customer's CSV under the names of the contract: ``external_user_id, source_name,
    audio_url`` (null for blank), the six axes from 0 to 100, ``kpi_<name>``, one column for each
    ``attr_<name>``, and ``complete``, whether all six axes are there."""
    named = {header(c): F.col(f"`{c}`").cast("string") for c in df.columns}
    text = lambda n: F.nullif(F.trim(named[n]), F.lit("")) if n in named else F.lit(None).cast("string")
    axes = {a: clamp(number(named[f"{a}_score"]), 0.0, 100.0) if f"{a}_score" in named else F.lit(None).cast("double") for a in AXES}
    axes = {a: F.when(number(named[f"{a}_score"]).isNotNull(), c) if f"{a}_score" in named else c for a, c in axes.items()}
    whole = F.lit(True)
    for c in axes.values():
        whole = whole & c.isNotNull()
    kpis = [number(c).alias(n) for n, c in named.items() if n.startswith("kpi_")]
    extra = [text(n).alias(n[5:]) for n in named if n.startswith("attr_")]
    return df.select(*[text(n).alias(n) for n in ("external_user_id", "source_name", "audio_url")], *[c.alias(a) for a, c in axes.items()], *kpis, *extra, whole.alias("complete"))


def unknown_columns(df: DataFrame) -> list[str]:
    known = {"external_user_id", "source_name", "audio_url", *[f"{a}_score" for a in AXES]}
    return [h for h in map(header, df.columns) if h not in known and not h.startswith(("attr_", "kpi_"))]


def probe(df: DataFrame, kind: str) -> DataFrame:
    """``check, status, said``: what a delivery of a kind of report would give.

    Checks: columns of the kind's groups, a column with an identifier, and the share of rows
    that give tags: pass from 80 % on, warn above none, fail at none.
    """
    shape = "web" if kind == "ctv" and is_web_shaped(df.columns) else kind
    met, missing, unknown = alias_coverage(df.columns, shape)
    found = [("groups", "pass" if not missing else "warn" if met else "fail", ", ".join(missing)), ("unknown columns", "warn" if unknown else "pass", ", ".join(unknown))]
    base = df.sparkSession.createDataFrame(found, "check string, status string, said string")
    total = df.agg(F.count("*").alias("n"), F.count_if(identifier_of(df).isNotNull()).alias("named"))
    tagged = normalise_rows(df, shape).agg(F.count("*").alias("tagged"))
    share = total.crossJoin(tagged).select("n", (F.col("named") / F.nullif("n", F.lit(0))).alias("a"), (F.col("tagged") / F.nullif("n", F.lit(0))).alias("b"))
    grade = lambda c: F.when(c >= 0.8, "pass").when(c > 0, "warn").otherwise("fail")
    rows = share.select(F.explode(F.array(F.struct(F.lit("identifiers").alias("check"), grade(F.col("a")).alias("status"), F.round("a", 4).cast("string").alias("said")), F.struct(F.lit("yield").alias("check"), grade(F.col("b")).alias("status"), F.round("b", 4).cast("string").alias("said")))).alias("x")).select("x.*")
    return base.unionByName(rows)


def report_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("checks"))


def merged_report(old: DataFrame, new: DataFrame, key: str = "check") -> DataFrame:
    """The old report with the checks of the new one in place of its own."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))



#: Names that columns of users and devices go by, the likeliest first.
USER_KEYS = ("maid", "device_id", "deviceid", "idfa", "gaid", "user_id", "userid", "hem", "hashed_email", "ip")
#: Size of a distinct-count sketch (its base-2 logarithm), whose error is under one percent, and how
#: far below the number of rows an estimate may lie for the column to be looked at exactly.
SKETCH_SIZE, KEY_SLACK = 14, 0.03


def column_sketches(df: DataFrame) -> DataFrame:
    """``file, column, rows, nulls, sketch`` of every file and column of a table that was read from
    files, in one pass: mergeable sketches of the distinct values, as text."""
    per = lambda c: F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), SKETCH_SIZE).alias("sketch"))
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.array(*[per(c) for c in df.columns]).alias("c")).select("file", F.inline("c"))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """``column, files, rows, nulls, distinct`` of the sketches of files, whenever they were made."""
    merged = parts.groupBy("column").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("s"))
    return merged.select("column", "files", "rows", "nulls", F.hll_sketch_estimate("s").alias("distinct"))


def key_columns(df: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``column, rows, nulls, distinct, is_key, is_user``: the columns of a table, with those that
    identify its rows and, by its name, the likeliest one of users or devices.

    Columns without nulls whose estimate comes near the number of rows are looked at exactly; the
    rest can't be keys. ``parts`` are sketches that were kept. An empty table has no keys.
    """
    spark, found = df.sparkSession, merged_sketches(column_sketches(df) if parts is None else parts).collect()  # one row a column
    by_name = {r["column"].lower(): r["column"] for r in found}
    user = next((by_name[n] for n in USER_KEYS if n in by_name), None)
    rows = []
    for r in found:
        near = r.rows > 0 and r.nulls == 0 and r.distinct >= (1 - KEY_SLACK) * r.rows
        single = near and df.groupBy(f"`{r['column']}`").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        rows.append((r["column"], r.rows, r.nulls, r.distinct, bool(single), r["column"] == user))
    return spark.createDataFrame(rows, "column string, rows long, nulls long, distinct long, is_key boolean, is_user boolean")
