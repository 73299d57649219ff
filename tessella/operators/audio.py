"""Scores from measured audio features, rolling windows of them, and onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S

AXES = list(S.AXES)
#: The least and most that a measured feature can be.
BOUNDS = {
    "duration_s": (0, 86_400), "sample_rate": (1, 384_000), "rms": (0, 1), "dynamic_range": (0, 1), "centroid_hz": (0, 192_000), "flatness": (0, 1),
    "rolloff_hz": (0, 192_000), "zero_crossing": (0, 384_000), "speech_ratio": (0, 1), "voicing": (0, 1), "onset_rate": (0, 100), "activity": (0, 1),
}
#: How far a source's grounding is trusted.
TRUST = {"grounded": 1.0, "partial": 0.65, "inferred": 0.4, "ungrounded": 0.15}


def _unit(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(S.clamp(c, 0.0, 1.0))


def _scaled(name: str, low: float, high: float) -> Column:
    return _unit((F.col(name) - low) / (high - low))


def sanitised(df: DataFrame) -> DataFrame:
    """``df`` with each feature it lacks or has no number for at its least, the others in bounds."""
    out = {}
    for name, (low, high) in BOUNDS.items():
        c = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        out[name] = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), float(low)).otherwise(S.clamp(c, float(low), float(high)))
    return df.withColumns(out)


def axes_from_features(df: DataFrame) -> DataFrame:
    """``df`` (sanitised features) with the six axes, 8 to 97, and ``confidence``."""
    bright, noise, busy = _scaled("centroid_hz", 300, 6000), _unit(F.col("flatness") * 1.6), _scaled("onset_rate", 0.2, 6)
    speech, voiced, dyn = _unit(F.col("speech_ratio")), _unit(F.col("voicing")), _scaled("dynamic_range", 0.01, 0.35)
    body, level = _scaled("rolloff_hz", 1500, 11000), _scaled("rms", 0.01, 0.3)
    blend = {
        "emotional": 0.4 * dyn + 0.25 * level + 0.2 * voiced + 0.15 * (1 - noise),
        "cognitive": 0.4 * speech + 0.25 * (1 - busy) + 0.2 * voiced + 0.15 * (1 - dyn),
        "social": 0.4 * busy + 0.3 * noise + 0.2 * body + 0.1 * level,
        "communication": 0.5 * speech + 0.3 * voiced + 0.2 * (1 - bright),
        "contextual": 0.35 * noise + 0.3 * body + 0.2 * (1 - dyn) + 0.15 * F.col("activity"),
        "artistic": 0.35 * (1 - noise) + 0.25 * busy + 0.2 * bright + 0.2 * dyn,
    }
    sure = S.half_up(_unit(0.65 * F.col("activity") + 0.35 * _scaled("duration_s", 1, 15)), 2)
    return df.withColumns({**{a: S.half_up(S.clamp(F.round(b * 100, 9), 8.0, 97.0)) for a, b in blend.items()}, "confidence": sure})


def spectrum_axes(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """``df`` with the six axes as the mean of six equal bands of an array, in hundredths; what is
    left at the end belongs to none."""
    v = F.col(spectrum)
    per = F.greatest(F.lit(1), F.floor(F.size(v) / len(AXES)).cast("int"))
    out = {}
    for i, a in enumerate(AXES):
        band = F.filter(F.transform(F.sequence(F.lit(0), per - 1), lambda k: F.get(v, k + per * i)), lambda x: x.isNotNull())  # noqa: B023
        mean = F.aggregate(band, F.lit(0.0), lambda s, x: s + x) / F.size(band)
        out[a] = S.half_up(_unit(F.round(mean, 9)) * 100)
    return df.withColumns(out)


def peakiness(values: Column) -> Column:
    """One less the entropy over its most: 1 for a single peak, 0 for a flat array or less than two values."""
    kept = F.transform(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    entropy = -F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))
    return F.when((F.size(kept) < 2) | (total <= 0), 0.0).otherwise(_unit(1 - entropy / F.ln(F.size(kept))))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def _rms(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / F.size(values))).otherwise(0.0)


def musical_scores(df: DataFrame, musical: Column | None = None) -> DataFrame:
    """``df`` with ``pitch, rhythm, timbre`` (0 to 100) and ``musicality`` from measured means:
    arrays ``chroma, tonnetz, contrast, mfcc`` and ``flatness, tempo, beat_regularity, onset_rate,
    centroid_hz, rolloff_hz, zero_crossing``. ``musical`` is the share of music among the tags of
    music and speech, null for none."""
    num = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    clear = peakiness(F.col("chroma"))
    tone = _unit(_rms(F.col("tonnetz")) * 2)
    pitch = 0.55 * clear + 0.3 * tone + 0.15 * (1 - _unit(num("flatness")))
    tempo = F.col("tempo")
    steady = F.when(tempo.isNull(), 0.4).when(tempo.between(60, 180), 1.0).otherwise(_unit(1 - F.least(F.abs(tempo - 120) - 60, F.lit(120.0)) / 120))
    beat = _unit(num("beat_regularity"))
    rhythm = 0.45 * beat + 0.3 * steady + 0.25 * _unit(1 - F.abs(F.least(num("onset_rate"), F.lit(12.0)) - 3.5) / 8.5)
    spread = F.when(F.size("mfcc") > 1, _unit(_rms(F.slice("mfcc", F.lit(2), F.greatest(F.lit(1), F.size("mfcc") - 1))) / 40)).otherwise(0.0)
    timbre = 0.35 * _unit(_mean(F.col("contrast")) / 40) + 0.25 * spread + 0.2 * _unit(num("rolloff_hz") / 11000) + 0.2 * _unit(num("centroid_hz") / 5000)
    heard = _unit(0.4 * clear + 0.35 * beat + 0.25 * (1 - F.least(_unit(num("zero_crossing")) * 4, F.lit(1.0))))
    share = F.lit(None).cast("double") if musical is None else musical
    sure = F.when(share.isNull(), heard).otherwise(_unit(0.6 * share + 0.4 * heard))
    points = lambda c: S.half_up(F.round(_unit(c) * 100, 9))
    return df.withColumns({"pitch": points(pitch), "rhythm": points(rhythm), "timbre": points(timbre), "musicality": S.half_up(F.round(sure, 9), 2)})


def originality(df: DataFrame, similarities: str = "similarities") -> DataFrame:
    """``df`` with ``originality`` (0 to 100) and ``evidence`` (0 to 1) from ``grounding_level,
    confidence``, the similarities of its tags, and ``pitch, rhythm, timbre, musicality`` (null
    without measured audio)."""
    trust = F.coalesce(*[F.when(F.lower("grounding_level") == k, w) for k, w in TRUST.items()], F.lit(0.3))
    grounded = _unit(0.35 * trust + 0.65 * _unit(F.coalesce("confidence", F.lit(0.0))))
    sims = F.transform(F.filter(F.coalesce(similarities, F.array().cast("array<double>")), lambda x: x > 0), lambda x: F.least(x, F.lit(1.0)))
    some = F.size(sims) > 0
    spread = F.when(F.size(sims) > 1, F.array_max(sims) - F.array_min(sims)).otherwise(0.0)
    taxonomy = F.when(some, _unit(0.75 * (1 - _mean(sims)) + 0.25 * _unit(spread))).otherwise(0.5)
    trio = F.array(*[_unit(F.col(c) / 100) for c in ("pitch", "rhythm", "timbre")])
    mean = _mean(trio)
    dev = F.sqrt(_mean(F.transform(trio, lambda x: (x - mean) * (x - mean))))
    musical = _unit(F.coalesce("musicality", F.lit(0.0)))
    own = _unit((0.6 * _unit(dev / 0.25) + 0.4 * F.array_max(trio)) * musical + 0.5 * (1 - musical))
    craft = F.when(F.col("pitch").isNotNull(), own).otherwise(0.5)
    score = S.half_up(F.round(_unit(0.3 * grounded + 0.35 * taxonomy + 0.35 * craft) * 100, 9))
    evidence = _unit(0.4 * trust + 0.3 * some.cast("double") + 0.3 * F.when(F.col("pitch").isNotNull(), musical).otherwise(0.0))
    return df.withColumns({"originality": score, "evidence": S.half_up(F.round(evidence, 9), 3)})


def window_features(frames: DataFrame, key: str, at: str, width: str = "5 seconds", order: str | None = None, places: int = 12) -> DataFrame:
    """``key, start, n, rms, centroid_hz, brightness, chroma`` of tumbling windows of frames: means,
    the chroma's by place. With ``order`` numbers are added in that order, whatever tasks hold the
    frames, so equal tables give equal means to the last bit; a chroma has ``places`` then at most."""
    w = F.window(at, width).start.alias("start")
    base = frames.select(key, w, "rms", "centroid_hz", "chroma", *([F.col(order).alias("__o")] if order else []))
    summed = _summed_in_order(base, key, places) if order else _summed(base, key)
    return summed.select(key, "start", "n", "rms", "centroid_hz", S.clamp(F.col("centroid_hz") / 4000, 0.0, 1.0).alias("brightness"), F.transform(F.coalesce("sums", F.array().cast("array<double>")), lambda x: x / F.col("n")).alias("chroma"))


def _summed(base: DataFrame, key: str) -> DataFrame:
    plain = base.groupBy(key, "start").agg(F.count("*").alias("n"), F.avg("rms").alias("rms"), F.avg("centroid_hz").alias("centroid_hz"))
    bins = base.select(key, "start", F.posexplode("chroma").alias("p", "x")).groupBy(key, "start", "p").agg(F.sum("x").alias("x"))
    chroma = bins.groupBy(key, "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("sums"))
    return plain.join(chroma, [key, "start"], "left")


def _summed_in_order(base: DataFrame, key: str, places: int) -> DataFrame:
    """Running sums, of which the last row of each window has them all."""
    window = Window.partitionBy(key, "start").orderBy("__o")
    run, whole = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {f"__s{i}": F.sum(F.get("chroma", F.lit(i))).over(run) for i in range(places)}
    longest = F.max(F.size("chroma")).over(run)
    rows = base.withColumns({"rms": F.avg("rms").over(run), "centroid_hz": F.avg("centroid_hz").over(run), **sums, "__longest": longest, "n": F.count("*").over(run), "__all": F.count("*").over(whole)}).where("n = __all")
    fits = F.when(F.col("__longest") > places, F.raise_error(F.lit(f"a chroma has over {places} places"))).otherwise(F.greatest("__longest", F.lit(0)))
    return rows.withColumn("sums", F.slice(F.array(*sums), F.lit(1), fits))


def onsets(flux: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, onsets``: peaks of the flux over its mean and one deviation: as high as the frame
    before and higher than the one after; none for fewer than five frames."""
    level = flux.groupBy(key).agg((F.avg(value) + F.stddev_pop(value)).alias("__level"), F.count("*").alias("__n"))
    w = Window.partitionBy(key).orderBy(order)
    near = flux.select(key, F.col(value).alias("__v"), F.lag(value).over(w).alias("__a"), F.lead(value).over(w).alias("__b"))
    peak = (F.col("__v") > F.col("__level")) & (F.col("__v") >= F.col("__a")) & (F.col("__v") > F.col("__b")) & (F.col("__n") > 4)
    return near.join(level, key).groupBy(key).agg(F.count_if(peak).alias("onsets"))


def recent_trail(entries: DataFrame, key: str, at: str = "t", order: str = "nth", most: int = 40, near: float = 0.01) -> DataFrame:
    """The ``most`` latest entries of each key, by time, without those that a later arrival (by
    ``order``) within ``near`` seconds replaces."""
    cell = lambda c: F.floor(F.col(c) / near).cast("long")
    here = entries.select(key, F.col(at).alias("__t"), F.col(order).alias("__o"), F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)).alias("__c"))
    later = entries.withColumn("__c", cell(at)).join(here, [key, "__c"], "left").where((F.col("__o") > F.col(order)) & (F.abs(F.col("__t") - F.col(at)) <= near)).select(key, order).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(order)))
    return entries.join(later, [key, order], "left_anti").withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def versions(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """``df`` with ``<value>_change`` since the version before; null for the first."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{v}_change": F.col(v) - F.lag(v).over(w) for v in values})


def described(df: DataFrame) -> Column:
    """Words for a window of ``rms, centroid_hz, chroma`` and its axes."""
    energy = F.when(F.col("rms") > 0.55, "loud").when(F.col("rms") > 0.22, "moderate").otherwise("quiet")
    hz = F.col("centroid_hz")
    bright = F.when(hz > 3200, "very bright, sibilant").when(hz > 1800, "bright").when(hz > 900, "warm").otherwise("dark, bass-heavy")
    ranked = F.array_sort(F.array(*[F.struct((-F.coalesce(F.col(a), F.lit(0.0))).alias("v"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(AXES)]))
    top = F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["a"]), " and ")
    pitches = F.array(*[F.lit(p) for p in "C C# D D# E F F# G G# A A# B".split()])
    key = F.when(F.size("chroma") == 12, F.concat(F.lit(" with "), F.element_at(pitches, F.array_position("chroma", F.array_max("chroma")).cast("int")), F.lit(" as the dominant pitch class"))).otherwise("")
    kind = F.when(F.col("communication") >= 55, "speech-forward").otherwise("music-forward")
    return F.concat(F.lit("A "), energy, F.lit(", "), bright, F.lit(" "), kind, F.lit(" audio segment"), key, F.lit(", strongest on "), top, F.lit(" semantics."))


#: Words of tags that tell of music and of speech.
MUSIC_WORDS = "music|instrument|guitar|piano|drum|violin|synth|bass|singing|song|melody|orchestr|choir|percussion"
SPEECH_WORDS = "speech|speak|narrat|conversation|talk|voice|monologue|podcast|dialog|announc"


def music_share(tags: DataFrame, key: str) -> DataFrame:
    """``key, musical``: of ``code, label, similarity`` tags the similarity of those of music as a share of
    that of music and speech, null without either: what ``musical_scores`` takes."""
    said, weight = F.concat_ws(" ", F.coalesce("code", F.lit("")), F.coalesce("label", F.lit(""))), F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0)))
    of = lambda words: F.sum(F.when(said.rlike(f"(?i){words}"), weight).otherwise(0.0))
    per = tags.groupBy(key).agg(of(MUSIC_WORDS).alias("m"), of(SPEECH_WORDS).alias("s"))
    return per.select(key, F.when(F.col("m") + F.col("s") > 0, F.col("m") / (F.col("m") + F.col("s"))).alias("musical"))
