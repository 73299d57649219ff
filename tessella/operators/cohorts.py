"""Cohorts of signal points: facets, tilted scores, two-stage clusters, and impact of site tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions.storage import numbered, written
from tessella.operators.learning import bootstrap

AXES = list(S.AXES)
#: The names of the first cohorts; later ones have numbers.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The confidence of a score that comes without one, and of no score at all.
SCORED_CONFIDENCE, NEUTRAL_CONFIDENCE = 0.6, 0.15


def facets(df: DataFrame, blobs: Mapping[str, str], codes: str = "tag_codes") -> Column:
    """Distinct ``(kind, label)`` facets: of JSON blobs (kind to column) their activation, scope and
    the category, daypart and network of their ``rows``, then the last parts of the codes. Labels
    that differ in case only are one, the first."""
    row = "array<struct<CategoryName:string,GenreName:string,TaxonomyName:string,Name:string,Daypart:string,NetworkName:string,AppName:string>>"
    facet = lambda k, c: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), F.trim(c).alias("label"))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    told = lambda k: lambda r: F.array(facet(k, F.coalesce(*[full(r[n]) for n in ("CategoryName", "GenreName", "TaxonomyName", "Name")])), facet("ctv", r["Daypart"]), facet(k, F.coalesce(full(r["NetworkName"]), full(r["AppName"]))))
    parts = []
    for kind, column in blobs.items():
        blob = F.col(column)
        rows = F.coalesce(F.from_json(F.get_json_object(blob, "$.rows"), row), F.array().cast(row))
        first = F.array(facet("activation", F.concat(F.lit("Activation "), F.get_json_object(blob, "$.activation_id"))), facet("scope", F.replace(F.get_json_object(blob, "$.scope"), F.lit("_"), F.lit(" "))))
        each = F.transform(rows, told(kind))
        parts += [first, F.flatten(each)]
    leaf = lambda c: F.replace(F.element_at(F.split(c, r"\."), -1), F.lit("-"), F.lit(" "))
    tags = F.transform(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: c != ""), lambda c: facet(F.when(F.startswith(c, F.lit("ctv")), "ctv").otherwise("app"), leaf(c)))
    found = F.filter(F.concat(*parts, tags), lambda f: F.coalesce(f["label"], F.lit("")) != "")
    same = lambda a, b: (a["kind"] == b["kind"]) & (F.lower(a["label"]) == F.lower(b["label"]))
    return F.filter(found, lambda f, i: ~F.exists(F.slice(found, F.lit(1), i), lambda g: same(f, g)))


def signal_points(df: DataFrame, rules: Sequence[tuple[str, Mapping[str, float]]], labels: str = "labels") -> DataFrame:
    """``df`` with the six axes, ``confidence`` and ``basis``: own scores (``own``: a struct of axes
    and confidence) as they are, else inherited ones (``inherited``) or 50 each, moved by every
    rule (pattern to axes' tilts) for each label that it fits. What is not own counts for three
    quarters of its confidence if a rule fits, else for two fifths, from 0.05 to 0.9."""
    fits = lambda pattern: lambda x: x.rlike(pattern)
    hits = [F.size(F.filter(F.coalesce(labels, F.array().cast("array<string>")), fits(p))) for p, _ in rules]
    own, base = F.col("own").isNotNull(), F.coalesce("own", "inherited")
    out, moved = {}, F.lit(0.0)
    for a in AXES:
        tilt = sum((h * float(t.get(a, 0.0)) for h, (_, t) in zip(hits, rules)), F.lit(0.0))
        moved = moved + F.abs(tilt)
        out[a] = S.clamp(F.coalesce(base[a], F.lit(50.0)) + F.when(own, 0.0).otherwise(tilt), 0.0, 100.0)
    sure = S.clamp(F.coalesce(base["confidence"], F.when(own, SCORED_CONFIDENCE).otherwise(NEUTRAL_CONFIDENCE)), 0.0, 1.0)
    weak = S.clamp(sure * F.when(moved > 0, 0.75).otherwise(0.4), 0.05, 0.9)
    basis = F.when(own, "scored").when(F.col("inherited").isNotNull(), "inherited").otherwise("facet-only")
    return df.withColumns({**out, "confidence": F.when(own, sure).otherwise(weak), "basis": basis})


def _gap(centre: Sequence[float]) -> Column:
    return F.sqrt(sum(((F.col(a) - float(c)) * (F.col(a) - float(c)) for a, c in zip(AXES, centre)), F.lit(0.0)))


def _halves(rows: DataFrame, most_rounds: int) -> Column:
    """Which of two centres, from the point nearest to the mean and the one farthest from it, a
    row is nearest to after Lloyd's rounds; the first of those that tie."""
    of = lambda r: [float(r[a]) for a in AXES]
    mean = of(rows.agg(*[F.avg(a).alias(a) for a in AXES]).first())
    first = of(rows.agg(F.min_by(F.struct(*AXES), F.struct(F.round(_gap(mean), 9), "id")).alias("v")).first().v)
    second = of(rows.agg(F.min_by(F.struct(*AXES), F.struct(-F.round(_gap(first), 9), "id")).alias("v")).first().v)
    centres, before = [first, second], None
    for _ in range(most_rounds):
        side = (F.round(_gap(centres[1]), 9) < F.round(_gap(centres[0]), 9)).cast("int")
        now = sorted((r.s, r.n, of(r)) for r in rows.groupBy(side.alias("s")).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in AXES]).collect())
        if now == before:
            break
        before = now
        for s, _, v in now:
            centres[s] = v
    return (F.round(_gap(centres[1]), 9) < F.round(_gap(centres[0]), 9)).cast("int")


def cluster_signals(points: DataFrame, budget: int, most_rounds: int = 25) -> DataFrame:
    """``id, cohort``: points (``id, signature``, axes) by signature, and as long as there are fewer
    groups than ``budget``, the largest group of four or more whose axes vary cut in two.

    Each cut is a few aggregates over its group; groups without variation stay whole. Cohorts
    are numbered by size, largest first, then by their least id.
    """
    rows = written(points.select("id", F.coalesce("signature", F.lit("unattributed")).alias("g"), *AXES), "points")
    spread = F.greatest(*[F.max(a) - F.min(a) for a in AXES]) > 1e-6
    whole: set[str] = set()
    while True:
        # One row a group, no more than the budget.
        sizes = rows.groupBy("g").agg(F.count("*").alias("n"), spread.alias("varies")).orderBy(F.desc("n"), "g").limit(budget).collect()
        open_ = [r for r in sizes if r.varies and r.n >= 4 and r.g not in whole]
        if len(sizes) >= budget or not open_:
            break
        own = written(rows.where(F.col("g") == open_[0].g), "group")
        side = _halves(own, most_rounds)
        if own.select(side.alias("s")).distinct().count() < 2:
            whole.add(open_[0].g)
            continue
        cut = own.withColumn("g", F.concat("g", F.lit("/"), side.cast("string")))
        rows = written(rows.where(F.col("g") != open_[0].g).unionByName(cut), "points")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    named = numbered(groups, [F.desc("n"), F.col("least")], "cohort")
    return rows.join(named.select("g", F.col("cohort").cast("int").alias("cohort")), "g").select("id", "cohort")


def cohort_summary(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """``cohort, members, share, cohesion, lead``, the mean axes and ``avg_confidence``."""
    joined = points.join(assigned, "id")
    centres = joined.groupBy("cohort").agg(F.count("*").alias("members"), F.avg("confidence").alias("avg_confidence"), *[F.avg(a).alias(f"c_{a}") for a in AXES])
    far = F.sqrt(sum(((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in AXES), F.lit(0.0)))
    spread = joined.join(F.broadcast(centres.drop("members", "avg_confidence")), "cohort").groupBy("cohort").agg(F.avg(far).alias("far"))
    total = joined.agg(F.count("*").alias("all"))  # one row
    out = centres.join(spread, "cohort").crossJoin(F.broadcast(total)).select("cohort", "members", (F.col("members") / F.col("all")).alias("share"), F.greatest(F.lit(0.0), 1 - F.col("far") / F.sqrt(F.lit(60000.0))).alias("cohesion"), *[F.col(f"c_{a}").alias(a) for a in AXES], "avg_confidence")
    return out.withColumn("lead", S.leading_axis(AXES))


def cohort_members(assigned: DataFrame, holdout: float = 0.1) -> DataFrame:
    """``cohort, slug, subject_key, holdout`` of ``id, cohort`` rows without aggregate keys: cohorts
    are named by letters, from the 27th on by numbers, and a member's arm follows from both names."""
    key = F.col("id").cast("string")
    name = F.coalesce(F.get(F.array(*[F.lit(c) for c in LETTERS.lower()]), F.col("cohort").cast("int")), (F.col("cohort") + 1).cast("string"))
    slug = F.concat(F.lit("cohort-"), name)
    return assigned.where(~S.is_aggregate_key(key)).select("cohort", slug.alias("slug"), key.alias("subject_key"), S.is_holdout(slug, key, holdout).alias("holdout"))


def confidence_parts(df: DataFrame, tiers: Mapping[str, float]) -> DataFrame:
    """``df`` with ``mean``, population ``sd`` and ``spread`` of a row's axes, the ``factor`` of its
    confidence over the spread, and the ``tier`` of the nearest factor, the first of those that tie."""
    zero = {a: F.coalesce(F.col(a), F.lit(0.0)) for a in AXES}
    mean = sum(zero.values(), F.lit(0.0)) / len(AXES)
    sd = F.sqrt(sum(((c - mean) * (c - mean) for c in zero.values()), F.lit(0.0)) / len(AXES))
    spread = S.clamp(sd / 30, 0.1, 1.0)
    factor = F.coalesce("confidence", F.lit(0.0)) / spread
    gaps = {t: F.round(F.abs(factor - f), 9) for t, f in tiers.items()}
    least = F.least(*gaps.values()) if len(gaps) > 1 else next(iter(gaps.values()))
    return df.withColumns({"mean": mean, "sd": sd, "spread": spread, "factor": factor, "tier": F.coalesce(*[F.when(g == least, t) for t, g in gaps.items()])})


def tag_impact(events: DataFrame, records: DataFrame, rows: DataFrame, metric: str | None = None, least: int = 24, draws: int = 200, penalty: float = 1e-2) -> tuple[str | None, DataFrame, DataFrame]:
    """What the axes of audio mean for a site tag: the metric, its drivers and predictions.

    The metric of most devices, then events, then by name, is taken, unless one is named. The
    mean value of each device is fitted on the axes of its record, in hundredths; axes that do
    not vary stay out. Drivers: ``term, per_10, low, high, conclusive``. Predictions: ``id,
    predicted, delta, delta_pct`` against the mean, and ``lead``, the conclusive axis that moves
    the row most. Fewer than ``least`` devices with a record, or no axis that varies, give none.
    """
    spark = events.sparkSession
    told = events.where("metric is not null and value is not null and device_id is not null")
    if metric is None:
        best = told.groupBy("metric", "device_id").agg(F.count("*").alias("n")).groupBy("metric").agg(F.count("*").alias("d"), F.sum("n").alias("n")).orderBy(F.desc("d"), F.desc("n"), "metric").first()
        metric = best and best.metric
    empty = spark.createDataFrame([], "term string, per_10 double, low double, high double, conclusive boolean"), rows.select("id", *[F.lit(None).cast("double").alias(c) for c in ("predicted", "delta", "delta_pct")], F.lit(None).cast("string").alias("lead")).limit(0)
    if metric is None:
        return None, *empty
    per = told.where(F.col("metric") == metric).groupBy("device_id").agg(F.avg("value").alias("y"))
    fitted = written(records.join(per, "device_id").select("device_id", "y", *[(F.coalesce(a, F.lit(0.0)) / 100).alias(a) for a in AXES]), "impact")
    stats = fitted.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(a).alias(a) for a in AXES], *[(F.max(a) - F.min(a)).alias(f"r_{a}") for a in AXES]).first()
    used = [a for a in AXES if stats.n and stats[f"r_{a}"] > 1e-6]
    if stats.n < least or not used:
        return metric, *empty
    fit = {r.term: r for r in bootstrap(fitted, used, "y", "device_id", penalty, draws).collect()}
    if not fit:
        return metric, *empty
    drivers = spark.createDataFrame([(a, fit[a].coefficient / 10, fit[a].low and fit[a].low / 10, fit[a].high and fit[a].high / 10, fit[a].conclusive) for a in used], "term string, per_10 double, low double, high double, conclusive boolean")
    share = {a: fit[a].coefficient * (F.coalesce(F.col(a), F.lit(0.0)) / 100 - float(stats[a])) for a in used}
    predicted = F.lit(fit["intercept"].coefficient) + sum((fit[a].coefficient * F.coalesce(F.col(a), F.lit(0.0)) / 100 for a in used), F.lit(0.0))
    sure = [a for a in used if fit[a].conclusive]
    top = F.greatest(*[F.abs(share[a]) for a in sure]) if len(sure) > 1 else F.abs(share[sure[0]]) if sure else None
    lead = F.coalesce(*[F.when(F.abs(share[a]) == top, a) for a in sure]) if sure else F.lit(None).cast("string")
    base = float(np.float64(stats.y))
    return metric, drivers, rows.select("id", predicted.alias("predicted"), (predicted - base).alias("delta"), ((predicted - base) / abs(base) * 100 if base else F.lit(None).cast("double")).alias("delta_pct"), lead.alias("lead"))
