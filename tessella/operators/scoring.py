"""Scoring of queued identifiers through a cache of signatures, with any scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S

AXES = list(S.AXES)


def known_codes(codes: Column, before: Column) -> Column:
    """Whether an identifier has tags already and nothing new comes."""
    return (F.size(F.coalesce(before, F.array())) > 0) & (F.size(F.array_except(codes, F.coalesce(before, F.array()))) == 0)


def tasks_of_rollups(rollups: DataFrame, object_key: str, report_type: str, after: str | None = None, most: int | None = None, most_tags: int = 64) -> DataFrame:
    """Tasks of the subjects of one object's rollups, in order after a subject, ``most`` of them:
    their heaviest codes, and a confidence that grows with how many they are."""
    own = rollups.where(F.col("object_key") == object_key)
    own = own if after is None else own.where(F.col("subject") > after)
    if most is not None:
        own = own.join(own.select("subject").distinct().orderBy("subject").limit(most), "subject", "left_semi")
    per = own.groupBy("subject", "code").agg(F.sum("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("weight"), "code"))
    top = per.withColumn("r", rank).where(F.col("r") <= most_tags).groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "code"))), lambda x: x["code"]).alias("codes"))
    return top.select(F.lit(object_key).alias("object_key"), F.lit(report_type).alias("report_type"), F.substring("subject", 1, 512).alias("identifier"), "codes", F.least(0.4 + 0.05 * F.size("codes"), F.lit(0.9)).alias("confidence"))


def open_signatures(queue: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct signatures of pending rows that are not cached (``signature, report_type,
    codes, n``), and the hits of those that are (``signature, hits``)."""
    pending = queue.where("status = 'pending'").withColumn("signature", S.tag_signature("report_type", "codes"))
    per = pending.groupBy("signature").agg(F.first("report_type").alias("report_type"), F.first(F.array_sort(F.array_distinct("codes"))).alias("codes"), F.count("*").alias("n"))
    return per.join(cache.select("signature"), "signature", "left_anti"), per.join(cache.select("signature").distinct(), "signature", "left_semi").select("signature", F.col("n").alias("hits"))


def prewarmed(queue: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with what ``scorer`` makes of the open signatures: it gets ``signature,
    report_type, codes`` and returns ``signature`` with the six axes and ``confidence``."""
    todo, _ = open_signatures(queue, cache)
    scored = scorer(todo.select("signature", "report_type", "codes"))
    return cache.select("signature", *AXES, "confidence").unionByName(scored.select("signature", *AXES, "confidence"))


def stub_scorer(todo: DataFrame) -> DataFrame:
    """Axes from the digits of the signature: the same ones on every run, for tests."""
    digit = lambda i: F.conv(F.substring("signature", 2 * i + 1, 2), 16, 10).cast("double") / 255 * 100
    return todo.withColumns({**{a: S.half_up(digit(i)) for i, a in enumerate(AXES)}, "confidence": F.lit(0.5)})


def materialised(queue: DataFrame, cache: DataFrame, identifiers: DataFrame) -> dict[str, DataFrame]:
    """What pending rows with a cached signature become: ``analyses`` of their identifiers, ``tags``,
    the merged ``identifiers`` (codes and observations added) and the ``queue`` with them done."""
    signed = queue.withColumn("signature", S.tag_signature("report_type", "codes"))
    kept = cache.select("signature", F.lit(True).alias("__hit"), *[F.col(a).alias(f"__{a}") for a in AXES])
    joined = signed.join(kept, "signature", "left").withColumn("__done", F.coalesce(F.col("__hit") & (F.col("status") == "pending"), F.lit(False)))
    done = joined.where("__done")
    analyses = done.select("id", "identifier", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), *[F.round(F.coalesce(f"__{a}", F.lit(0.0))).alias(a) for a in AXES])
    tags = done.select("identifier", F.explode(F.array_distinct("codes")).alias("code"), F.coalesce("confidence", F.lit(0.5)).alias("weight")).groupBy("identifier", "code").agg(F.max("weight").alias("weight"))
    new = done.groupBy("identifier").agg(F.count("*").alias("observations"), F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"))
    both = identifiers.select("identifier", "observations", "codes").unionByName(new)
    merged = both.groupBy("identifier").agg(F.sum("observations").alias("observations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    after = joined.withColumn("status", F.when(F.col("__done"), "done").otherwise(F.col("status"))).select(*queue.columns)
    return {"analyses": analyses, "tags": tags, "identifiers": merged, "queue": after}


def scores_by_name(records: DataFrame, analyses: DataFrame, cache: DataFrame) -> DataFrame:
    """``record_id``, the axes, ``confidence`` and ``basis``: of the newest analysis of the record's
    source name, else of the newest cached score of it, with a confidence of one half, else none."""
    newest = lambda df: df.groupBy("source_name").agg(F.max_by(F.struct(*AXES, *(["confidence"] if "confidence" in df.columns else [])), "created_at").alias("s"))
    own = newest(analyses).withColumnRenamed("s", "a")
    kept = newest(cache.drop("confidence")).withColumnRenamed("s", "c")
    joined = records.join(own, "source_name", "left").join(kept, "source_name", "left")
    value = lambda n: F.when(F.col("a").isNotNull(), F.col("a")[n]).otherwise(F.col("c")[n]).alias(n)
    basis = F.when(F.col("a").isNotNull(), "analysis").when(F.col("c").isNotNull(), "cache")
    confidence = F.when(F.col("a").isNotNull(), F.col("a.confidence")).when(F.col("c").isNotNull(), 0.5)
    return joined.select("record_id", *[value(a) for a in AXES], confidence.alias("confidence"), basis.alias("basis"))
