"""Tags, rollups and six-axis profiles of users from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import AXES, clamp, exact_mean, logistic_percentile

#: Event types behind the first five axes; the sixth takes all events.
AXIS_EVENTS = ("error", "click", "purchase", "view", "signup")


def event_tags(events: DataFrame) -> DataFrame:
    """``user_id, code, day, weight``: one row per event and tag (its type, and its ``k`` in tens)."""
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array_compact(F.array(F.concat(F.lit("type."), "event_type"), F.concat(F.lit("k."), F.floor(k / 10).cast("string"))))
    return events.select("user_id", F.explode(codes).alias("code"), F.to_date("ts").alias("day"), F.lit(1).alias("weight"))


def rollup_tags(tags: DataFrame) -> DataFrame:
    """``user_id, code, day, weight`` summed: partial sums first, then by key."""
    return tags.groupBy("user_id", "code", "day").agg(F.sum("weight").alias("weight"))


def top_tags(rollup: DataFrame, most: int = 64) -> DataFrame:
    """``user_id, code, weight, days, rank`` of the heaviest codes of each user; ties by code."""
    per = rollup.groupBy("user_id", "code").agg(F.sum("weight").alias("weight"), F.count("*").alias("days"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "code"))
    return per.withColumn("rank", rank).where(F.col("rank") <= most)


def axis_profiles(events: DataFrame) -> DataFrame:
    """``user_id``, the six axes (0 to 100, null without events of the kind), ``confidence``, ``n``."""
    cap = lambda c: F.least(F.lit(100.0), c)
    axes = [cap(exact_mean(F.when(F.col("event_type") == e, F.col("value")))).alias(a) for a, e in zip(AXES, AXIS_EVENTS)]
    n = F.count("*")
    return events.groupBy("user_id").agg(*axes, cap(exact_mean("value")).alias(AXES[-1]), F.least(F.lit(1.0), n / 100).alias("confidence"), n.alias("n"))


def filled(profiles: DataFrame, default: float = 50.0) -> DataFrame:
    """Profiles with ``default`` for missing axes."""
    return profiles.fillna(default, subset=list(AXES))


def fingerprint_percentiles(profiles: DataFrame) -> DataFrame:
    """Each axis as its logistic percentile in the population: mean 50 and deviation 1 stand
    in where the population has none. The population's moments are one row."""
    moments = profiles.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = profiles.crossJoin(F.broadcast(moments))
    out = [logistic_percentile(a, F.coalesce(f"m_{a}", F.lit(50.0)), F.coalesce(f"s_{a}", F.lit(1.0))).alias(a) for a in AXES]
    return joined.select("user_id", *out)


def unpivoted(profiles: DataFrame) -> DataFrame:
    """``user_id, axis, score`` of the axes that are set."""
    return profiles.unpivot("user_id", list(AXES), "axis", "score").where("score is not null")


def axis_histogram(profiles: DataFrame, width: int = 10) -> DataFrame:
    """``axis, bin, n``: bins of ``width`` points, the last one closed."""
    at = F.least(F.floor(F.col("score") / width), F.lit(100 // width - 1)).cast("int")
    return unpivoted(profiles).groupBy("axis", at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_medians(histogram: DataFrame, width: int = 10) -> DataFrame:
    """``axis, median`` by linear interpolation in the bin where half of the rows are reached."""
    w = Window.partitionBy("axis")
    run = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    parts = histogram.withColumn("run", run).withColumn("half", F.sum("n").over(w) / 2)
    reached = parts.where((F.col("run") >= F.col("half")) & (F.col("run") - F.col("n") < F.col("half")))
    return reached.select("axis", (F.col("bin") * width + width * (F.col("half") - F.col("run") + F.col("n")) / F.col("n")).alias("median"))


def reach_bands(events: DataFrame) -> DataFrame:
    """``band, users``: users by how many events they have."""
    n = F.col("n")
    band = F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")
    return events.groupBy("user_id").agg(F.count("*").alias("n")).groupBy(band.alias("band")).agg(F.count("*").alias("users"))


def score_trend(events: DataFrame, bucket: str = "day") -> DataFrame:
    """``bucket, n, score`` for every bucket between the first and last event; empty ones have
    0 rows and a null score."""
    if bucket not in ("day", "week", "month"):
        raise ValueError(f"unknown bucket: {bucket}")
    per = events.groupBy(F.to_date(F.date_trunc(bucket, "ts")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("score"))
    ends = per.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    days = ends.where("a is not null").select(F.explode(F.expr(f"sequence(a, b, interval 1 {bucket})")).alias("bucket"))
    return days.join(per, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "score")


def audience_insights(tags: DataFrame, most: int = 5) -> DataFrame:
    """``family, code, users, share, rank``: the codes with most users of each family (the part
    before the dot), and their share of the family's."""
    per = tags.groupBy("code").agg(F.countDistinct("user_id").alias("users"))
    per = per.withColumn("family", F.split_part("code", F.lit("."), F.lit(1)))
    w = Window.partitionBy("family")
    share = F.col("users") / F.sum("users").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("users"), "code"))
    return per.select("family", "code", "users", share.alias("share"), rank.alias("rank")).where(F.col("rank") <= most)


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    names = df.columns
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").select(*names)


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``n, mean, m2`` of the union of parts that have ``n, mean, m2`` each, by Chan's formula."""
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sq"))
    return total.select(*keys, "n", "mean", F.greatest(F.lit(0.0), F.col("within") + F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")).alias("m2"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def fit_to(target: dict[str, float], weights: dict[str, float] | None = None) -> Column:
    """``1 - sum(w * |difference|) / (100 * sum(w))``, from 0 to 1."""
    weights = weights or dict.fromkeys(AXES, 1.0)
    total = 100 * sum(weights.values())
    distance = sum((F.lit(weights[a]) * F.abs(F.col(a) - F.lit(float(target[a]))) for a in AXES), F.lit(0.0))
    return clamp(1 - distance / total, 0.0, 1.0)
