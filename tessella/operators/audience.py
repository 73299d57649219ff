"""Matching audiences to a target profile: fit, cohorts, reach curves and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import AXES, clamp, export_id, is_holdout, leading_axis
from tessella.operators.profiles import fit_to

#: Archetype names and their six axes.
ARCHETYPES = {
    "torchbearer": (75, 48, 52, 70, 50, 52),
    "architect": (48, 75, 45, 50, 52, 70),
    "gatherer": (52, 48, 75, 55, 70, 50),
    "cartographer": (50, 70, 48, 45, 75, 55),
    "flame": (75, 50, 45, 52, 48, 70),
    "herald": (55, 48, 70, 75, 50, 45),
    "contemplative": (45, 75, 45, 48, 70, 52),
    "weaver": (52, 50, 75, 55, 48, 70),
    "pilgrim": (70, 48, 45, 50, 75, 55),
    "prism": (55, 50, 48, 70, 45, 75),
    "anchor": (48, 70, 75, 52, 50, 45),
    "undertow": (75, 70, 45, 48, 52, 50),
}


def fit_histogram(profiles: DataFrame, target: dict[str, float], weights: dict[str, float] | None = None, boosted: DataFrame | None = None, boost: float = 0.15) -> DataFrame:
    """``bucket, users``: users by fit, in a hundred buckets from 1; a fit of 1 is in bucket 101."""
    # A fit that is rounded before may pass into the next bucket.
    bucket = F.least(F.floor(F.round(F.col("fit") * 100, 6)), F.lit(100)).cast("int") + 1
    return _unrounded(profiles, target, weights, boosted, boost).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("users"))


def fitted(profiles: DataFrame, target: dict[str, float], weights: dict[str, float] | None = None, boosted: DataFrame | None = None, boost: float = 0.15) -> DataFrame:
    """``profiles`` with ``fit`` to the target under ``weights`` (1 where missing); users of
    ``boosted`` (``user_id``), as those whose sound is near, get ``boost`` (up to 0.5) on top."""
    return _unrounded(profiles, target, weights, boosted, boost).withColumn("fit", F.round("fit", 6))


def _unrounded(profiles: DataFrame, target: dict[str, float], weights: dict[str, float] | None, boosted: DataFrame | None, boost: float) -> DataFrame:
    if boosted is None:
        return profiles.withColumn("fit", fit_to(target, weights))
    near = boosted.select("user_id").distinct().withColumn("__near", F.lit(True))
    raised = clamp(fit_to(target, weights) + F.when(F.col("__near"), min(max(boost, 0.0), 0.5)).otherwise(0.0), 0.0, 1.0)
    return profiles.join(near, "user_id", "left").withColumn("fit", raised).drop("__near")


def best_fits(profiles: DataFrame, target: dict[str, float], most: int, weights: dict[str, float] | None = None, boosted: DataFrame | None = None, boost: float = 0.15) -> DataFrame:
    """``user_id, fit, lead`` of the ``most`` best fits; ties by user."""
    scored = fitted(profiles, target, weights, boosted, boost).select("user_id", "fit", leading_axis(list(AXES)).alias("lead"))
    return scored.orderBy(F.desc("fit"), "user_id").limit(most)


def cohort(profiles: DataFrame, target: dict[str, float], least_fit: float, name: str, holdout: float = 0.1, weights: dict[str, float] | None = None, boosted: DataFrame | None = None, boost: float = 0.15, most: int | None = None) -> DataFrame:
    """``user_id, fit, holdout``: users that fit, the ``most`` best of them, and which are held out."""
    scored = fitted(profiles, target, weights, boosted, boost).select("user_id", "fit").where(F.col("fit") >= least_fit)
    if most is not None:
        scored = scored.orderBy(F.desc("fit"), "user_id").limit(most)
    return scored.withColumn("holdout", is_holdout(F.lit(name), F.col("user_id").cast("string"), holdout))


def reach_curve(histogram: DataFrame, steps: int = 12) -> DataFrame:
    """``threshold, reach``: users in or above each of ``steps`` buckets that divide the occupied
    ones evenly. The histogram has 101 rows at most."""
    ends = histogram.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.ceil(F.col("a") + (F.col("b") - F.col("a")) * i / (steps - 1))))
    thresholds = ends.select(at.alias("threshold")).distinct()
    return thresholds.join(F.broadcast(histogram), F.col("bucket") >= F.col("threshold")).groupBy("threshold").agg(F.sum("users").alias("reach"))


def neighbours(profiles: DataFrame, target: dict[str, float], most: int) -> DataFrame:
    """``user_id, similarity, top_shared`` of the ``most`` (25 at most) nearest, with the first axis
    on which both are highest: ``(0.3 cosine + 0.7 (1 - distance / sqrt(60000))) ^ 1.5``."""
    t = [F.lit(float(target[a])) for a in AXES]
    c = [F.col(a) for a in AXES]
    total = lambda xs: sum(xs, F.lit(0.0))
    norm = F.sqrt(total(x * x for x in c)) * F.sqrt(total(x * x for x in t))
    cosine = F.when(norm > 0, total(x * y for x, y in zip(c, t)) / norm).otherwise(0.0)
    distance = F.sqrt(total((x - y) * (x - y) for x, y in zip(c, t)))
    similarity = F.pow(F.greatest(F.lit(0.0), 0.3 * cosine + 0.7 * (1 - distance / F.sqrt(F.lit(60000.0)))), F.lit(1.5))
    both = [x + y for x, y in zip(c, t)]
    shared = F.coalesce(*[F.when(s == F.greatest(*both), a) for a, s in zip(AXES, both)])
    return profiles.select("user_id", F.round(similarity, 6).alias("similarity"), shared.alias("top_shared")).orderBy(F.desc("similarity"), "user_id").limit(min(max(most, 1), 25))


def archetypes(profiles: DataFrame, centres: dict[str, tuple] = ARCHETYPES) -> DataFrame:
    """``user_id, archetype, distance`` of the nearest centre; the first of those that tie."""
    far = [F.round(F.sqrt(sum(((F.col(a) - F.lit(float(x))) * (F.col(a) - F.lit(float(x))) for a, x in zip(AXES, xs)), F.lit(0.0))), 6) for xs in centres.values()]
    least = F.least(*far)
    name = F.coalesce(*[F.when(d == least, n) for n, d in zip(centres, far)])
    return profiles.select("user_id", name.alias("archetype"), least.alias("distance"))


def lift(outcomes: DataFrame, least: int = 5) -> DataFrame:
    """One row from ``arm`` (exposed or holdout) and ``value``: means, Welch's 95 % interval
    of their difference, and the relative lift; null with fewer than ``least`` in an arm."""
    arm = lambda a, f: f(F.when(F.col("arm") == a, F.col("value")))
    s = outcomes.agg(*[arm(a, f).alias(f"{n}_{a}") for a in ("exposed", "holdout") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    enough = (F.col("n_exposed") >= least) & (F.col("n_holdout") >= least)
    delta = F.col("m_exposed") - F.col("m_holdout")
    half = 1.96 * F.sqrt(F.col("v_exposed") / F.col("n_exposed") + F.col("v_holdout") / F.col("n_holdout"))
    told = lambda c: F.when(enough, c)
    return s.select("n_exposed", "n_holdout", told(delta).alias("delta"), told(delta - half).alias("low"), told(delta + half).alias("high"), told(F.when(F.col("m_holdout") != 0, delta / F.abs("m_holdout"))).alias("relative_lift"))


def arms(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``eid, value, arm`` for ``lift``: mean outcome of each member by export id; an id that is
    both exposed and held out is exposed, ids of no member are left out."""
    named = members.select(export_id("subject_key").alias("eid"), F.coalesce("holdout", F.lit(False)).alias("holdout")).where("eid is not null")
    side = named.groupBy("eid").agg(F.when(F.bool_and("holdout"), "holdout").otherwise("exposed").alias("arm"))
    values = outcomes.where("value is not null").groupBy(export_id("subject_key").alias("eid")).agg(F.avg("value").alias("value"))
    return values.join(side, "eid").select("eid", "value", "arm")
