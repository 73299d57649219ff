"""Catalogues of labels, albums and tracks: originality, ranks, facets and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators.taxonomy import ancestors

#: Words of spoken titles, how far levels of grounding are trusted (others by one
#: half), and what the three legs of a label's score weigh.
SPOKEN = ("podcast", "interview", "voice", "vo ", "speech", "talk", "episode", "audiobook", "narration", "sermon", "lecture", "news", "commentary")
TRUST = {"grounded": 1.0, "strong": 1.0, "partial": 0.6, "weak": 0.35, "ungrounded": 0.1, "none": 0.1}
LEGS = {"originality": 0.45, "grounding": 0.35, "completeness": 0.2}


def symbol_scores(tracks: DataFrame) -> DataFrame:
    """``symbol, score, tracks``: the rounded mean of the scored tracks that carry it."""
    rows = tracks.where("score is not null").select("id", "score", F.explode(F.array_distinct(F.transform("symbols", lambda x: F.trim(x)))).alias("symbol")).where("symbol <> ''")
    return rows.groupBy("symbol").agg(S.half_up(F.avg("score")).alias("score"), F.count("*").alias("tracks"))


def originality_rollup(items: DataFrame) -> DataFrame:
    """``id, score, basis, tracks`` of ``id, parent_id, kind, symbols, score``: a track's own score;
    above, the mean of the symbols of the scored tracks below and of its own, weighted by their
    tracks, else the plain mean of those tracks."""
    scored = items.where("kind = 'track' and score is not null").select("id", S.clamp("score", 0.0, 100.0).alias("score"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))
    marks = symbol_scores(scored).withColumnsRenamed({"score": "mark", "tracks": "weight"})
    up = ancestors(items.select("id", "parent_id")).join(items.where("kind <> 'track'").select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    below = up.join(scored, "id").select(F.col("ancestor").alias("top"), "id", "score", "symbols")
    plain = below.groupBy("top").agg(F.count("*").alias("tracks"), F.avg("score").alias("plain"))
    carried = below.select("top", F.explode("symbols").alias("symbol")).unionByName(items.where("kind <> 'track'").select(F.col("id").alias("top"), F.explode("symbols").alias("symbol")))
    weighed = carried.select("top", F.trim("symbol").alias("symbol")).distinct().join(marks, "symbol").groupBy("top").agg((F.sum(F.col("mark") * F.col("weight")) / F.sum("weight")).alias("weighed"))
    above = items.where("kind <> 'track'").select(F.col("id").alias("top")).join(plain, "top", "left").join(weighed, "top", "left")
    basis = F.when(F.col("weighed").isNotNull(), "symbols").when(F.col("plain").isNotNull(), "measured").otherwise("none")
    high = above.select(F.col("top").alias("id"), S.half_up(F.coalesce("weighed", "plain")).alias("score"), basis.alias("basis"), F.coalesce("tracks", F.lit(0)).alias("tracks"))
    own = items.where("kind = 'track'").select("id", F.when(F.col("score").isNotNull(), S.half_up(S.clamp("score", 0.0, 100.0))).alias("score"), F.when(F.col("score").isNotNull(), "measured").otherwise("none").alias("basis"), F.col("score").isNotNull().cast("int").alias("tracks"))
    return own.unionByName(high)


def label_score(originality: Column, grounding: Column, completeness: Column) -> tuple[Column, Column]:
    """A label's score and its weakest leg, the first of those that tie; missing legs are 0."""
    legs = {n: F.coalesce(c, F.lit(0.0)) for n, c in zip(LEGS, (originality, grounding, completeness))}
    score = S.half_up(S.clamp(F.round(sum((LEGS[n] * c for n, c in legs.items()), F.lit(0.0)), 9), 0.0, 100.0))
    least = F.least(*legs.values())
    return score, F.coalesce(*[F.when(c == least, n) for n, c in legs.items()])


def label_ranking(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """``id, title, score, originality, grounding, completeness, tracks, gap`` of the labels of
    ``id, parent_id, kind, title, symbols, source_id, release_year, score`` with ``source_id,
    confidence, grounding_level`` analyses; best first."""
    trust = F.coalesce(*[F.when(F.lower("grounding_level") == k, w) for k, w in TRUST.items()], F.lit(0.5))
    sure = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.coalesce("confidence", F.lit(0.0)))
    labels = items.where("kind = 'label'").select(F.col("id").alias("label"), "title")
    up = ancestors(items.select("id", "parent_id")).join(labels.select(F.col("label").alias("ancestor")), "ancestor", "left_semi")
    rows = up.join(items.select("id", "kind", "symbols", "source_id", "release_year"), "id").join(analyses.select("source_id", sure.alias("sure"), trust.alias("trust")), "source_id", "left")
    track = lambda c: F.count_if((F.col("kind") == "track") & c)
    per = rows.groupBy(F.col("ancestor").alias("label")).agg(
        F.count_if(F.col("kind") == "album").alias("albums"), track(F.lit(True)).alias("tracks"), track(F.col("source_id").isNotNull()).alias("linked"),
        track(F.size(F.coalesce("symbols", F.array())) > 0).alias("marked"), track(F.col("release_year").isNotNull()).alias("dated"),
        F.avg(F.when(F.col("kind") == "track", F.col("sure") * F.col("trust"))).alias("g"),
    )
    share = lambda c: F.col(c) / F.greatest(F.lit(1), F.col("tracks")) * 100
    whole = 0.2 * F.when(F.col("albums") > 0, 100.0).otherwise(0.0) + 0.2 * F.least(F.lit(100.0), F.col("tracks") * 20.0) + 0.25 * share("linked") + 0.2 * share("marked") + 0.15 * share("dated")
    joined = labels.join(per, "label").join(originality_rollup(items).select(F.col("id").alias("label"), F.col("score").alias("originality")), "label", "left")
    joined = joined.withColumns({"grounding": S.clamp(F.col("g") * 100, 0.0, 100.0), "completeness": S.clamp(F.round(whole, 9), 0.0, 100.0)})
    score, gap = label_score(F.col("originality"), F.col("grounding"), F.col("completeness"))
    out = joined.select(F.col("label").alias("id"), "title", score.alias("score"), "originality", F.round("grounding", 4).alias("grounding"), S.half_up("completeness").alias("completeness"), "tracks", gap.alias("gap"))
    return out.orderBy(F.desc("score"), "title", "id")


def facets(sources: DataFrame, providers: dict[str, str], data_providers: tuple[str, ...], music_providers: tuple[str, ...]) -> DataFrame:
    """``sources`` (``source_type, file_url, name, album_name``) with ``provider`` (the first of
    ``providers``' patterns in the type, ``upload`` for files, else ``other``), ``kind`` (user data
    or audio), ``content`` and ``file_type``."""
    low = F.lower(F.coalesce("source_type", F.lit("")))
    named = F.coalesce(*[F.when(F.contains(low, F.lit(p)), n) for p, n in providers.items()], F.when(F.contains(low, F.lit("upload")) | F.contains(low, F.lit("file")) | F.col("file_url").isNotNull(), "upload"), F.lit("other"))
    out = sources.withColumn("provider", named)
    extension = F.lower(F.element_at(F.split(F.element_at(F.split("file_url", r"\?"), 1), r"\."), -1))
    data, music = F.col("provider").isin(*data_providers), F.col("provider").isin(*music_providers)
    kind = F.when(data, "user_data").otherwise("audio")
    file_type = F.when(F.col("file_url").isNotNull() & F.length(extension).between(1, 5), extension).when(music, "stream").when(data, "signal").otherwise("other")
    title = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("album_name", F.lit(""))))
    spoken = F.lit(False)
    for word in SPOKEN:
        spoken = spoken | F.contains(title, F.lit(word))
    content = F.when(spoken, "spoken_word").when(data, "mixed").when(music, "music").otherwise("mixed")
    return out.withColumns({"kind": kind, "content": content, "file_type": file_type})


def facet_counts(faceted: DataFrame, *names: str) -> DataFrame:
    """``facet, value, n`` of each facet over all rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in names])).alias("f")
    return faceted.select(pairs).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def chosen(faceted: DataFrame, **facet: str) -> DataFrame:
    """The rows with these facets; ``all`` stands for any."""
    out = faceted
    for name, value in facet.items():
        out = out if value == "all" else out.where(F.col(name) == value)
    return out


def page(df: DataFrame, *order: Column, offset: int = 0, most: int = 25) -> DataFrame:
    """A page of rows: ``most`` (1 to 100) after ``offset`` in ``order``, which ends in a unique column."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(most, 1), 100))


def optional(column: str, value: object | None) -> Column:
    """Whether a column has a value; true for all if the value is None."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def tag_frequencies(df: DataFrame, tags: str = "tags") -> DataFrame:
    """``code, n``: how many rows hold each code, most first."""
    return df.select(F.explode(F.array_distinct(tags)).alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")
