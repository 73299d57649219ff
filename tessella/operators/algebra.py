"""Score algebra: fingerprints, damping, priors, attribution, comparison and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S

AXES = list(S.AXES)
#: Share of each axis that speech explains.
SPEECH_LOAD = dict(zip(AXES, (0.05, 0.2, 0.1, 0.6, 0.05, 0.15)))
#: Words that lift an axis of a text.
LEXICON = {
    "emotional": "emotion happy sad love romance drama fear anger joy calm melancholy uplift intense tender nostalg hope tension warm".split(),
    "cognitive": "news science education learn tech finance business analysis documentary tutorial strategy puzzle complex explain data research".split(),
    "social": "crowd party sport family friend community group team chat audience live event celebration together social gathering".split(),
    "communication": "speech speak talk voice vocal narration dialog podcast interview announce presenter host commentary spoken 语 monologue message".split(),
    "contextual": "outdoor indoor street traffic weather rain city nature kitchen store retail travel car home office venue ambient room poi location place restaurant shop".split(),
    "artistic": "music art design film cinema creative instrument guitar piano melody harmony composition style aesthetic craft dance theatre".split(),
}


def _sum(xs) -> Column:
    return sum(xs, F.lit(0.0))


def user_fingerprints(analyses: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per ``user_id``: each axis as the confidence-weighted mean of its percentiles in the whole
    population (50 without any), the same for the last ``days`` as ``<axis>_recent`` (0 without
    any), counts, and the fingerprint's confidence, which ten analyses fill."""
    moments = analyses.agg(*[F.coalesce(F.avg(a), F.lit(50.0)).alias(f"m_{a}") for a in AXES], *[F.coalesce(F.stddev_samp(a), F.lit(1.0)).alias(f"s_{a}") for a in AXES])
    # The population is one row.
    rows = analyses.crossJoin(F.broadcast(moments)).withColumn("recent", F.col("created_at") > F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {int(days)} days"))
    rows = rows.select("user_id", "confidence", "recent", *[S.logistic_percentile(a, F.col(f"m_{a}"), F.col(f"s_{a}")).alias(a) for a in AXES])
    mean = lambda a, w, default: F.coalesce(F.sum(F.col(a) * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(default))
    all_, late = F.col("confidence"), F.when(F.col("recent"), F.col("confidence"))
    return rows.groupBy("user_id").agg(
        *[F.round(mean(a, all_, 50.0), 2).alias(a) for a in AXES], *[F.round(mean(a, late, 0.0), 2).alias(f"{a}_recent") for a in AXES],
        F.count("*").alias("sources"), F.count_if("recent").alias("recent_sources"), F.round(F.least(F.lit(1.0), F.count("*") / 10) * F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("confidence"),
    )


def drift(fingerprints: DataFrame) -> DataFrame:
    """``user_id, distance_pct, axis, direction``: how far the recent axes lie from all, and the
    axis that moved most; flat and without an axis where nothing is recent."""
    delta = {a: F.col(f"{a}_recent") - F.col(a) for a in AXES}
    none = F.greatest(*[F.abs(f"{a}_recent") for a in AXES]) == 0
    far = F.sqrt(_sum(d * d for d in delta.values()))
    most = F.greatest(*[F.abs(d) for d in delta.values()])
    moved = F.coalesce(*[F.when(F.abs(d) == most, d) for d in delta.values()])
    axis = F.coalesce(*[F.when(F.abs(d) == most, a) for a, d in delta.items()])
    way = F.when(moved > 2, "up").when(moved < -2, "down").otherwise("flat")
    out = F.least(F.lit(100.0), far / F.sqrt(F.lit(60000.0)) * 100)
    return fingerprints.select("user_id", F.when(none, 0.0).otherwise(F.round(out, 4)).alias("distance_pct"), F.when(~none, axis).alias("axis"), F.when(none, "flat").otherwise(way).alias("direction"))


def damp_speech(df: DataFrame, bias: float, gains: dict[str, float] | None = None, redistribute: bool = True, stages: bool = False) -> DataFrame:
    """The six axes with speech damped: each loses ``bias`` of its speech share, what they lose is
    given back by what of them is not speech, gains apply last; from 0 to 100, one decimal.

    With ``stages`` the columns ``<axis>_damped``, ``<axis>_given`` and ``<axis>_delta`` tell how.
    """
    bias, gains = min(1.0, max(0.0, bias)), gains or {}
    raw = {a: F.coalesce(F.col(a), F.lit(0.0)) for a in AXES}
    damped = {a: raw[a] * (1 - bias * SPEECH_LOAD[a]) for a in AXES}
    removed = _sum(raw[a] * bias * SPEECH_LOAD[a] for a in AXES)
    weight = {a: damped[a] * (1 - SPEECH_LOAD[a]) for a in AXES}
    total = _sum(weight.values())
    given = {a: F.when((removed > 0) & (total > 0), removed * weight[a] / total).otherwise(0.0) if redistribute else F.lit(0.0) for a in AXES}
    final = {a: S.half_up(S.clamp((damped[a] + given[a]) * (gains.get(a, 1.0) or 1.0), 0.0, 100.0), 1) for a in AXES}
    extra = {}
    if stages:
        for a in AXES:
            extra |= {f"{a}_damped": F.round(damped[a], 4), f"{a}_given": F.round(given[a], 4), f"{a}_delta": S.half_up(final[a] - raw[a], 1)}
    return df.withColumns({**extra, **final})


def auto_tune(scores: DataFrame) -> DataFrame:
    """One row: the mean axes, the ``bias`` that takes the excess of communication over the mean of
    the others, in steps of 0.05, and gains halfway to flat, from 0.5 to 1.5; none for no rows."""
    means = scores.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(a, F.lit(0.0))).alias(a) for a in AXES]).where("n > 0")
    step = lambda c: S.half_up(c * 20) / 20
    comm = F.col("communication")
    others = _sum(F.col(a) for a in AXES if a != "communication") / (len(AXES) - 1)
    bias = F.when((comm > 0) & (comm > others), S.clamp(step((comm - others) / comm / SPEECH_LOAD["communication"]), 0.0, 1.0)).otherwise(0.0)
    known = means.withColumn("bias", bias)
    damped = {a: F.col(a) * (1 - F.col("bias") * SPEECH_LOAD[a]) for a in AXES}
    weight = {a: damped[a] * (1 - SPEECH_LOAD[a]) for a in AXES}
    removed, total = _sum(F.col(a) * F.col("bias") * SPEECH_LOAD[a] for a in AXES), _sum(weight.values())
    level = {a: S.half_up(S.clamp(damped[a] + F.when((removed > 0) & (total > 0), removed * weight[a] / total).otherwise(0.0), 0.0, 100.0), 1) for a in AXES}
    mean = _sum(level.values()) / len(AXES)
    gain = {a: F.when((level[a] <= 0) | (mean <= 0), 1.0).otherwise(S.clamp(step(1 + 0.5 * (mean / level[a] - 1)), 0.5, 1.5)) for a in AXES}
    return known.select("n", *[F.round(a, 4).alias(a) for a in AXES], "bias", *[F.round(g, 2).alias(f"gain_{a}") for a, g in gain.items()])


def spread_ranks(df: DataFrame, centre: float = 55.0, step: float = 16.0) -> DataFrame:
    """Similarities of the six axes as scores: ``centre`` plus ``step`` for each deviation of the
    row, rounded, from 20 to 90."""
    mean = _sum(F.col(a) for a in AXES) / len(AXES)
    sd = F.sqrt(_sum((F.col(a) - mean) * (F.col(a) - mean) for a in AXES) / (len(AXES) - 1))
    return df.withColumns({a: S.half_up(S.clamp(centre + step * F.when(sd > 1e-6, (F.col(a) - mean) / sd).otherwise(0.0), 20.0, 90.0)) for a in AXES})


def feedback_bias(feedback: DataFrame, tags: DataFrame, rate: float = 0.25) -> DataFrame:
    """``node_id, category, bias``: what corrections (``source_id, category, predicted,
    corrected``) add to the bias of the source's nodes, each an equal share of ``rate``."""
    nodes = tags.groupBy("source_id").agg(F.count("*").alias("n"))
    step = (F.col("corrected") - F.col("predicted")) * rate / F.col("n")
    joined = feedback.join(nodes, "source_id").withColumn("step", step).where("step is not null and step != 0")
    return joined.join(tags, "source_id").groupBy("node_id", "category").agg(F.sum("step").alias("bias"))


def attribute_tags(tags: DataFrame, calibration: DataFrame, most: int = 6) -> DataFrame:
    """``subject, category, code, share, tag_score, rank``: of ``subject, code, weight`` tags with
    ``code, category, mean_score, n``, the evidence ``weight * mean / 100 * n / (n + 3)`` as a
    share of the category's, and the category's weighted mean score."""
    joined = tags.join(calibration, "code").withColumn("weight", F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)))).withColumn("n", F.greatest(F.lit(0), F.round("n")))
    scored = joined.withColumn("evidence", F.col("weight") * F.col("mean_score") / 100 * (F.col("n") / (F.col("n") + 3))).where("evidence > 0")
    w = Window.partitionBy("subject", "category")
    scored = scored.select(
        "subject", "category", "code", (F.col("evidence") / F.sum("evidence").over(w)).alias("share"),
        S.half_up(F.sum(F.col("weight") * F.col("mean_score")).over(w) / F.sum("weight").over(w)).alias("tag_score"), F.row_number().over(w.orderBy(F.desc("evidence"), "code")).alias("rank"),
    )
    return scored.where(F.col("rank") <= most)


def pooled_priors(calibration: DataFrame) -> DataFrame:
    """``category, mean, sd, n`` of ``category, mean_score, m2, n`` rows: the mean weighted by n,
    and the root of the summed variances over the number of categories that have any."""
    var = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).otherwise(0.0)
    per = calibration.groupBy("category").agg(F.sum("n").alias("n"), (F.sum(F.col("mean_score") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum(var).alias("v"))
    kinds = per.agg(F.greatest(F.lit(1), F.count("*")).alias("kinds"))  # one row
    return per.crossJoin(F.broadcast(kinds)).where("n > 0").select("category", S.half_up("mean").alias("mean"), S.half_up(F.sqrt(F.col("v") / F.col("kinds"))).alias("sd"), "n")


def axis_agreement(live: DataFrame, stored: DataFrame, key: str, tolerance: float = 12.0) -> DataFrame:
    """``key, max_delta, agrees`` of rows in both."""
    b = stored.select(key, *[F.col(a).alias(f"__{a}") for a in AXES])
    delta = [F.round(F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(f"__{a}", F.lit(0.0))), 9) for a in AXES]
    return live.join(b, key).select(key, F.greatest(*delta).alias("max_delta"), (F.greatest(*delta) <= tolerance).alias("agrees"))


def regression_drift(new: DataFrame, old: DataFrame, key: str, tolerance: float = 8.0) -> DataFrame:
    """``axis, n, mean_abs, max_abs, within``: how scores of the same rows have moved."""
    b = old.select(key, *[F.col(a).alias(f"__{a}") for a in AXES])
    joined = new.join(b, key).select(*[F.round(F.abs(F.col(a) - F.col(f"__{a}")), 9).alias(a) for a in AXES])
    one = joined.agg(*[F.struct(F.count(a).alias("n"), F.round(F.avg(a), 4).alias("mean_abs"), F.round(F.max(a), 4).alias("max_abs")).alias(a) for a in AXES])
    return one.unpivot([], AXES, "axis", "s").select("axis", "s.n", "s.mean_abs", "s.max_abs", (F.col("s.max_abs") <= tolerance).alias("within"))


def resonance(df: DataFrame, audience: dict[str, float], weights: dict[str, float] | None = None, shape: str = "euclidean") -> DataFrame:
    """``df`` with ``score`` (100 for equal axes, 0 for opposite corners), ``distance`` and
    ``weakest``, the first axis whose weighted gap costs most."""
    weights = weights or {}
    w = {a: max(0.0, weights.get(a, 1.0)) for a in AXES}
    gap = {a: F.coalesce(F.col(a), F.lit(0.0)) - float(audience.get(a, 0.0)) for a in AXES}
    flat = shape == "manhattan"
    cost = {a: w[a] * (F.abs(g) if flat else g * g) for a, g in gap.items()}
    worst, top = _sum(cost.values()), sum(w.values()) * (100.0 if flat else 10_000.0)
    distance, far = (worst, top) if flat else (F.sqrt(worst), top**0.5)
    score = 100 * (1 - distance / far) if far > 0 else F.lit(100.0)
    most = F.greatest(*cost.values())
    weakest = F.coalesce(*[F.when(c == most, a) for a, c in cost.items()])
    return df.withColumns({"score": S.half_up(S.clamp(score, 0.0, 100.0), 1), "distance": S.half_up(distance, 1), "weakest": weakest})


def profile_similarity(df: DataFrame, target: dict[str, float], config: dict[str, dict]) -> Column:
    """Weighted closeness, 0 to 100, of a row's axes to a target, both shifted by the profile's
    ``bias``; axes that are not ``enabled`` do not count. ``config``: axis to ``weight, bias, enabled``."""
    on = [a for a in AXES if config.get(a, {}).get("enabled", True)]
    weight = {a: float(config.get(a, {}).get("weight", 1.0)) for a in on}
    bias = {a: float(config.get(a, {}).get("bias", 0.0)) for a in on}
    if not on or sum(weight.values()) <= 0:
        return F.lit(0.0)
    mapped = lambda a, c: S.clamp(c + bias[a], 0.0, 100.0)
    diff = _sum(weight[a] * F.abs(mapped(a, F.lit(float(target.get(a, 0.0)))) - mapped(a, F.coalesce(F.col(a), F.lit(0.0)))) for a in on)
    return F.greatest(F.lit(0.0), 100 - diff / sum(weight.values()))


def compare_to_market(measured: DataFrame, market: DataFrame, weights: dict[str, float], least_live: int = 30) -> tuple[DataFrame, DataFrame]:
    """How ``track, metric, value`` rows stand in a market of ``metric, basis`` (live or
    published), ``mean, sd, sample``. A live cohort counts from ``least_live`` tracks on.

    First the rows ``track, metric, z, percentile, distinctiveness, basis``; then ``track,
    score, confidence``, weighted over its metrics.
    """
    usable = market.where("sd > 0").where((F.col("basis") != "live") | (F.col("sample") >= least_live))
    best = usable.groupBy("metric").agg(F.min_by(F.struct("mean", "sd", "basis"), F.when(F.col("basis") == "live", 0).otherwise(1)).alias("r"))
    weight = F.coalesce(*[F.when(F.col("metric") == m, F.lit(float(w))) for m, w in weights.items()])
    z = (F.col("value") - F.col("r.mean")) / F.col("r.sd")
    rows = measured.where("value is not null").join(F.broadcast(best), "metric").select("track", "metric", z.alias("z"), F.col("r.basis").alias("basis"), weight.alias("w")).where("w is not null")
    rows = rows.select("track", "metric", "z", "basis", "w", S.half_up(S.clamp(S.normal_cdf("z") * 100, 0.0, 100.0)).alias("percentile"), (F.least(F.abs("z"), F.lit(2.0)) * 50).alias("d"))
    live = F.sum(F.when(F.col("basis") == "live", F.col("w")).otherwise(0.0)) / F.sum("w")
    total = rows.groupBy("track").agg(S.half_up(F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("score"), S.half_up(F.round(S.clamp(0.75 * F.sum("w") + 0.25 * live, 0.0, 1.0), 9), 3).alias("confidence"))
    return rows.select("track", "metric", S.half_up("z", 2).alias("z"), "percentile", S.half_up("d").alias("distinctiveness"), "basis"), total


def meta_fingerprint(cohorts: DataFrame) -> DataFrame:
    """One row from ``members``, the axes and ``confidence`` of cohorts: the centroid weighted by
    members, ``dispersion_pct`` (their mean distance from it), and the confidence that is left."""
    total = cohorts.agg(F.sum("members").alias("n"), F.count("*").alias("cohorts"), *[(F.sum(F.col(a) * F.col("members")) / F.sum("members")).alias(f"c_{a}") for a in AXES]).where("cohorts > 0")
    far = F.sqrt(_sum((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in AXES))
    # The centroid is one row.
    per = cohorts.crossJoin(F.broadcast(total)).agg(*[F.first(f"c_{a}").alias(a) for a in AXES], F.first("n").alias("members"), F.first("cohorts").alias("cohorts"), (F.sum(far * F.col("members")) / F.sum("members")).alias("far"), (F.sum(F.col("confidence") * F.col("members")) / F.sum("members")).alias("c"))
    spread = F.when(F.col("cohorts") < 2, 0.0).otherwise(F.col("far") / F.sqrt(F.lit(60000.0)) * 100)
    return per.where("members > 0").select(*[F.round(a, 4).alias(a) for a in AXES], "members", "cohorts", F.round(spread, 1).alias("dispersion_pct"), F.round(S.clamp(F.col("c") * (1 - spread / 100), 0.0, 1.0), 3).alias("confidence"))


def text_fingerprint(tags: DataFrame, key: str, text: str = "text", weight: str = "weight", lexicon: dict[str, list[str]] = LEXICON, base: float = 42.0, lift: float = 46.0) -> DataFrame:
    """The six axes of ``key`` by the words of its tags' texts, relative to its strongest axis, and
    ``coverage``, the share of the weight that hits any word."""
    low = F.lower(F.col(text))
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    hits = {a: F.least(F.lit(2), sum((F.contains(low, F.lit(x)).cast("int") for x in words), F.lit(0))) for a, words in lexicon.items()}
    rows = tags.where(F.trim(text) != "").select(key, w.alias("__w"), *[(w * h).alias(a) for a, h in hits.items()])
    any_hit = F.greatest(*[F.col(a) for a in AXES]) > 0
    per = rows.groupBy(key).agg(*[F.sum(a).alias(a) for a in AXES], F.sum("__w").alias("all"), F.sum(F.when(any_hit, F.col("__w")).otherwise(0.0)).alias("hit"))
    top = F.greatest(F.lit(1.0), *[F.col(a) for a in AXES])
    return per.select(key, *[S.half_up(S.clamp(base + F.col(a) / top * lift, 0.0, 100.0)).alias(a) for a in AXES], S.half_up(F.col("hit") / F.col("all"), 2).alias("coverage"))


def grounding_level(evidence: Column, grounded_tag: Column, bridged: Column, neighbours: Column) -> Column:
    """``grounded``, ``bridged`` or ``text-only``: the strongest claim that the evidence proves."""
    said = F.lower(F.coalesce(evidence, F.lit("")))
    true = lambda c: F.coalesce(c, F.lit(False))
    return F.when(said.isin("clap", "librosa", "provider") | true(grounded_tag), "grounded").when(true(bridged) | true(neighbours) | (said == "neighbors"), "bridged").otherwise("text-only")


def rollup_confidence(tags: Column) -> Column:
    """0.4, and 0.05 more for each tag, up to 0.9."""
    return F.least(F.lit(0.4) + 0.05 * tags, F.lit(0.9))


def profile_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``profile, axis, changed, influence_before, influence_after`` of two versions of ``profile,
    axis, label, weight, bias, enabled``: what differs by over a thousandth, and the share of the
    enabled weights that an axis has."""

    def told(df: DataFrame, tag: str) -> DataFrame:
        on = F.when(F.col("enabled"), F.col("weight")).otherwise(0.0)
        whole = F.sum(on).over(Window.partitionBy("profile"))
        return df.select("profile", "axis", F.struct("label", "weight", "bias", "enabled").alias(tag), F.coalesce(on / F.nullif(whole, F.lit(0.0)), F.lit(0.0)).alias(f"share_{tag}"))

    a, b = F.col("a"), F.col("b")
    differs = (~a["label"].eqNullSafe(b["label"])) | (F.abs(a["weight"] - b["weight"]) > 0.001) | (F.abs(a["bias"] - b["bias"]) > 0.001) | (a["enabled"] != b["enabled"])
    joined = told(old, "a").join(told(new, "b"), ["profile", "axis"])
    return joined.select("profile", "axis", differs.alias("changed"), F.col("share_a").alias("influence_before"), F.col("share_b").alias("influence_after"))


def feature_hints(df: DataFrame, seed: Column, weight: Column) -> DataFrame:
    """``df`` with ``tempo, centroid_hz`` and ``energy`` as its axes, the weight of its tags and a
    hash of ``seed`` suggest where no audio was measured."""
    mean = _sum(F.coalesce(F.col(a), F.lit(0.0)) for a in AXES) / len(AXES)
    unit = lambda a: S.clamp(F.coalesce(F.col(a), F.lit(0.0)) / 100, 0.0, 1.0)
    speech, art, h = unit("communication"), unit("artistic"), S.fnv1a(seed)
    tempo = 72 + h % 40 + art * 46 - speech * 18
    centroid = 900 + speech * 2200 + art * 1400 + F.shiftright(h, 8) % 400
    energy = S.clamp(0.28 + mean / 260 + F.least(F.lit(0.35), weight * 0.12), 0.0, 1.0)
    return df.withColumns({"tempo": tempo, "centroid_hz": centroid, "energy": energy})


def divergence(a: DataFrame, b: DataFrame, key: str, least: float = 8.0, most: int = 3) -> DataFrame:
    """``key, axis, delta, divergent, similarity`` of rows in both: how far each axis lies apart, whether
    it is one of the ``most`` that carry the difference, by at least ``least``, and how near the
    rows are in all, from 0 to 100. Ties go to the first axis; missing values count as 0."""
    other = b.select(key, *[F.col(x).alias(f"__{x}") for x in AXES])
    delta = {x: F.round(F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(f"__{x}", F.lit(0.0))), 9) for x in AXES}
    ranked = F.array_sort(F.array(*[F.struct((-d).alias("d"), F.lit(i).alias("i")) for i, d in enumerate(delta.values())]))
    mean = _sum(delta.values()) / len(AXES)
    near = S.half_up(S.clamp(1 - mean / 100, 0.0, 1.0) * 100)
    rows = a.join(other, key).select(key, F.slice(F.transform(ranked, lambda r: r["i"]), 1, most).alias("__top"), near.alias("similarity"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("axis"), d.alias("delta")) for i, (x, d) in enumerate(delta.items())])).alias("s"))
    return rows.select(key, "s.axis", "s.delta", (F.array_contains("__top", F.col("s.i")) & (F.col("s.delta") >= least)).alias("divergent"), "similarity")


def trail_means(trail: DataFrame, key: str) -> DataFrame:
    """``key`` and the mean axes of all its windows; missing values count as 0."""
    return trail.groupBy(key).agg(*[F.avg(F.coalesce(a, F.lit(0.0))).alias(a) for a in AXES])
